"""Registered queries: each operator on the given tables, with its SQL twin."""

from entry_queries import (  # noqa: F401  (importing registers the queries)
    extras,
    files,
    model,
    relational,
    scoring,
    serving,
    text,
)
from entry_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
