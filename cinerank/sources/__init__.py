from cinerank.sources.readers import (
    read_csv_table,
    read_movies,
    read_ratings,
    read_table,
    read_users,
    rename_by_position,
    requests_frame,
    require_inputs,
)

__all__ = [
    "read_csv_table",
    "read_movies",
    "read_ratings",
    "read_table",
    "read_users",
    "rename_by_position",
    "requests_frame",
    "require_inputs",
]
