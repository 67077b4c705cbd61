"""Copies between tables that can be stopped and taken up again, and never put an older row
over a newer one.

A copy is staged once, in slices by a hash of the key.  Each slice is merged with the same
slice of the table in a job of its own, which writes fresh parts and then one row of
progress.  Once every slice has such a row, one commit makes the parts the table's next
version: readers see the table as it was before the copy or after it, never between.

What is at a table's path: ``pointer`` and ``parts`` (see ``snapshots``), and for each copy
``copies/<job>`` with ``begun``, ``progress`` and the refused rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.operators.topk import first_k
from cinerank.session import scratch_path
from cinerank.sinks.snapshots import Snapshot, commit, current, fresh_part, rows_at, versions

SLICE = "copy_slice"
FILES_PER_SLICE = 16
PARALLEL_SLICES = 4
_BEGUN = "staged string, slices int, version long, parts array<string>"
_PROGRESS = "slice int, part string, written long, refused long"


def _slice_of(key: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def _append(spark: SparkSession, row: tuple, schema: str, path: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def _begin(source: DataFrame, path: str, key: str, version: str, job: str, slices: int) -> Row:
    """The row that says where the copy is staged and what it is merged with."""
    spark = source.sparkSession
    begun = f"{path}/copies/{job}/begun"
    found = rows_at(spark, begun, _BEGUN).first()
    if found:
        return found
    since = current(spark, path)
    if since.parts and len(since.parts) != slices:
        raise ValueError(f"{path} has {len(since.parts)} slices, not {slices}")
    # A key's rows are cut to the newest before the shuffle, however many there are.
    ties = [F.col(f"`{c}`") for c in sorted(source.columns) if c not in (key, version)]
    newest = first_k(source, 1, key, [F.desc_nulls_last(version), *ties], "_place").drop("_place")
    # A slice is dealt to several files, so that its merge reads in parallel.
    file = F.pmod(F.xxhash64(F.lit(1), key), F.lit(FILES_PER_SLICE))
    staged = scratch_path(spark, "staged")
    placed = newest.withColumn(SLICE, _slice_of(key, slices)).repartition(SLICE, file)
    placed.write.partitionBy(SLICE).parquet(staged)
    # Written last: a copy that stops before this is staged anew.
    _append(spark, (staged, slices, since.version, list(since.parts)), _BEGUN, begun)
    return rows_at(spark, begun, _BEGUN).first()


def _newer(version: str) -> Column:
    """Whether the new row replaces the held one; a missing version is older than any other."""
    new, held = F.col(f"new.{version}"), F.col(f"held.{version}")
    return F.coalesce(new > held, new.isNotNull() & held.isNull())


def _merge_slice(new: DataFrame, held: DataFrame, key: str, version: str, part: str) -> DataFrame:
    """Write the merged slice at ``part``; gives key, version and held version of refused rows."""

    def sides(*columns: str) -> tuple[DataFrame, DataFrame, Column]:
        left = new.select(F.struct(*columns).alias("new"))
        right = held.select(F.struct(*columns).alias("held"))
        return left, right, F.col(f"new.{key}").eqNullSafe(F.col(f"held.{key}"))

    left, right, same = sides(*new.columns)
    takes = F.col("new").isNotNull() & (F.col("held").isNull() | _newer(version))
    winner = F.when(takes, F.col("new")).otherwise(F.col("held"))
    left.join(right, same, "full_outer").select(winner.alias("row")).select("row.*").write.parquet(part)
    left, right, same = sides(key, version)
    return left.join(right, same).filter(~_newer(version)).select(
        f"new.{key}", f"new.{version}", F.col(f"held.{version}").alias("held_version")
    )


def _copy_slice(
    spark: SparkSession,
    path: str,
    job: str,
    begun: Row,
    number: int,
    schema: T.StructType,
    key: str,
    version: str,
) -> tuple[int, str, int, int]:
    """Merge one slice; gives its row of progress."""
    staged = T.StructType([*schema, T.StructField(SLICE, T.IntegerType())])
    new = spark.read.schema(staged).parquet(begun["staged"])
    new = new.filter(F.col(SLICE) == number).drop(SLICE)
    old = begun["parts"][number] if begun["parts"] else None
    if old and new.isEmpty():
        part, written, refused = old, 0, 0
    else:
        # A task lost or a slice begun again writes to another folder.
        part = fresh_part(f"slice-{number}")
        held = spark.read.schema(schema).parquet(f"{path}/{old}") if old else new.limit(0)
        conflicts = _merge_slice(new, held, key, version, f"{path}/{part}")
        conflicts.write.parquet(f"{path}/copies/{job}/refused/{part}")
        refused = spark.read.parquet(f"{path}/copies/{job}/refused/{part}").count()
        written = new.count() - refused
    return number, part, written, refused


def copy_into(
    source: DataFrame,
    path: str,
    key: str,
    version: str,
    job: str,
    slices: int = 16,
    at_most: int | None = None,
) -> DataFrame:
    """Copy ``source`` into the table at ``path``: slice, written, refused, of the slices done.

    Of rows with one key the one with the largest ``version`` is copied, equal ones by their
    other columns.  It is refused if the table holds the key at the same or a later version.
    A missing key is a key like others, a missing version is older than any.

    ``job`` names the copy.  A call with the name of a copy that was stopped goes on with its
    staged rows, whatever ``source`` is then, and with slices that are not done; one that is
    complete is left as it is.  ``at_most`` bounds the slices of this call.  If another copy
    was committed since this one began, the commit is refused and the table stays as it is.
    """
    spark = source.sparkSession
    begun = _begin(source, path, key, version, job, slices)
    progress = f"{path}/copies/{job}/progress"
    done = {row["slice"] for row in rows_at(spark, progress, _PROGRESS).collect()}
    left = [number for number in range(begun["slices"]) if number not in done]

    def merge(number: int) -> tuple[int, str, int, int]:
        return _copy_slice(spark, path, job, begun, number, source.schema, key, version)

    with ThreadPoolExecutor(PARALLEL_SLICES) as pool:
        # Progress is written here alone: two appends to one folder would disturb each other.
        for row in pool.map(inheritable_thread_target(spark)(merge), left[:at_most]):
            _append(spark, row, _PROGRESS, progress)
    rows = rows_at(spark, progress, _PROGRESS)
    parts = [row["part"] for row in rows.orderBy("slice").collect()]
    if len(parts) == begun["slices"]:
        same = F.col("parts") == F.array(*map(F.lit, parts))
        if versions(spark, path).filter(same).isEmpty():
            commit(spark, path, Snapshot(begun["version"], tuple(begun["parts"])), parts)
    return rows.select("slice", "written", "refused")


def copied_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table's current version; empty where no copy is complete."""
    parts = current(spark, path).parts
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{part}" for part in parts])


def refused_rows(spark: SparkSession, path: str, job: str, schema: T.StructType | str) -> DataFrame:
    """Key, version and the held version of rows that a copy has refused so far.

    ``schema`` is of these three columns.  Slices begun but not finished do not count.
    """
    done = rows_at(spark, f"{path}/copies/{job}/progress", _PROGRESS).filter("refused > 0").collect()
    folders = [f"{path}/copies/{job}/refused/{row['part']}" for row in done]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
