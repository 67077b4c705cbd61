"""Text expressions shared by indexing and querying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokenise(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, from the whole text."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda token: token != "")


def document_json(*columns: Column | str) -> Column:
    """One JSON object per row; nested lists stay nested."""
    return F.to_json(F.struct(*columns))


def wildcard_to_like(pattern: Column) -> Column:
    """`*` and `?` wildcards as a LIKE pattern; `%`, `_` and `\\` are taken literally."""
    escaped = F.regexp_replace(pattern, r"([%_\\])", r"\\$1")
    return F.translate(escaped, "*?", "%_")
