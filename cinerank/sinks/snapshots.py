"""Tables that readers only ever see whole: immutable parts, and a pointer to the current ones.

A writer writes its parts to fresh folders first and then appends one row to the pointer
table, a single file that appears when it is complete.  A write that fails before that
leaves the old version as it is.  One writer at a time: a commit names the version it was
made from, and is refused if another came between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.sinks.tables import conform
from cinerank.sources.schemas import RECOMMENDATIONS

_POINTER = "version long, parts array<string>"


@dataclass(frozen=True)
class Snapshot:
    """A version and the folders, below the table's, that make it up."""

    version: int
    parts: tuple[str, ...]


def rows_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows at ``path``; none where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions committed: version, parts."""
    return rows_at(spark, f"{path}/pointer", _POINTER)


def current(spark: SparkSession, path: str) -> Snapshot:
    """The newest version; version 0 without parts where nothing was committed."""
    row = versions(spark, path).orderBy(F.desc("version")).first()
    return Snapshot(row["version"], tuple(row["parts"])) if row else Snapshot(0, ())


def fresh_part(label: str) -> str:
    """The name of a folder that no other part has."""
    return f"parts/{label}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, since: Snapshot, parts: Sequence[str]) -> Snapshot:
    """Make ``parts`` the current version, if ``since`` still is."""
    now = current(spark, path)
    if now != since:
        raise RuntimeError(f"{path}: version {now.version} was committed since {since.version}")
    new = Snapshot(since.version + 1, tuple(parts))
    row = spark.createDataFrame([(new.version, list(new.parts))], _POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return new


def _register(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    """The bucketed files at ``location`` as a table of this session."""
    name = f"published_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RECOMMENDATIONS)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY (user_id) SORTED BY (user_id) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def publish_version(recommendations: DataFrame, path: str, buckets: int = 64) -> Snapshot:
    """Write one row per user as the next version at ``path``, in ``buckets`` by user.

    ``buckets`` is kept by the part's name, so versions may differ in it.
    """
    spark = recommendations.sparkSession
    since = current(spark, path)
    part = fresh_part(f"lists-{buckets}")
    name = f"writing_{uuid.uuid4().hex}"
    writer = conform(recommendations, RECOMMENDATIONS).repartition(buckets, "user_id").write
    writer = writer.bucketBy(buckets, "user_id").sortBy("user_id").option("path", f"{path}/{part}")
    try:
        writer.format("parquet").saveAsTable(name)
    finally:
        # The table is external: its name goes, its files stay.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return commit(spark, path, since, [part])


def published_lists(spark: SparkSession, path: str, version: Snapshot | None = None) -> DataFrame:
    """The current version's lists; a join on user_id does not shuffle them."""
    found = version or current(spark, path)
    if not found.parts:
        return spark.createDataFrame([], RECOMMENDATIONS)
    (part,) = found.parts
    return _register(spark, f"{path}/{part}", int(part.split("-")[1]))
