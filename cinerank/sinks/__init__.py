from cinerank.sinks.copies import copied_table, copy_into, refused_rows
from cinerank.sinks.snapshots import publish_version, published_lists
from cinerank.sinks.tables import (
    append_metrics,
    conform,
    create_keyed_table,
    ensure_table,
    publish,
    publish_by_film,
    read_metrics,
    rebuild_table,
    upsert,
    upsert_into,
    write_csv,
    write_table,
)

__all__ = [
    "append_metrics",
    "conform",
    "copied_table",
    "copy_into",
    "create_keyed_table",
    "ensure_table",
    "publish",
    "publish_by_film",
    "publish_version",
    "published_lists",
    "read_metrics",
    "rebuild_table",
    "refused_rows",
    "upsert",
    "upsert_into",
    "write_csv",
    "write_table",
]
