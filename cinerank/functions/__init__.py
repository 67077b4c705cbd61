from cinerank.functions.catalogue import (
    default_title,
    epoch_to_utc,
    flag_name,
    genre_array,
    genre_text,
    parse_release_date,
)
from cinerank.functions.text import document_json, tokenise, wildcard_to_like
from cinerank.functions.vectors import dot, norm

__all__ = [
    "default_title",
    "document_json",
    "dot",
    "epoch_to_utc",
    "flag_name",
    "genre_array",
    "genre_text",
    "norm",
    "parse_release_date",
    "tokenise",
    "wildcard_to_like",
]
