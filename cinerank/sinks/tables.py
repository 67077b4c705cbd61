"""Writers.  Every write is distributed; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.operators.lists import FILM_PART, FILM_PARTS, film_part
from cinerank.operators.skew import lookup_join
from cinerank.operators.topk import explode_list, first_k
from cinerank.session import materialise
from cinerank.sources.schemas import RECOMMENDATIONS

# Entries of a folder of the table by film, and how many folders can be listed quickly.
FOLDER_ROWS = 1 << 20
MOST_FOLDERS = 4096


def write_csv(df: DataFrame, path: str) -> None:
    """CSV directory with headers.  Array columns are not allowed in CSV: pass text."""
    df.write.csv(path, header=True, mode="overwrite")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema``, in its order and types."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Keep a run's metrics row beside those of earlier runs, whatever columns these have."""
    metrics.coalesce(1).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs; a parameter that a run did not name is NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create an empty typed table unless something is there already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def rebuild_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Replace whatever is at ``path`` by ``df`` under the declared schema."""
    write_table(conform(df, schema), path)


def publish(recommendations: DataFrame, path: str) -> None:
    """One row per user, ordered by user so that a user lookup reads few row groups."""
    # Stored first: range partitioning reads its input twice.
    typed = materialise(conform(recommendations, RECOMMENDATIONS), "publish")
    write_table(typed.repartitionByRange("user_id").sortWithinPartitions("user_id"), path)


def publish_by_film(
    recommendations: DataFrame, path: str, folder_rows: int = FOLDER_ROWS
) -> None:
    """The inverted table: which users' lists hold a film, in folders by film.

    A folder holds the films of one hash, ordered by film and user, about ``folder_rows``
    entries.  The range key includes the user, so a film in most lists fills many files
    of its folder.
    """
    entries = explode_list(recommendations).select("movie_id", "user_id", "rank", "rating")
    rows = materialise(entries, "publish")
    parts = min(MOST_FOLDERS, rows.count() // folder_rows + 1)
    keys = [FILM_PART, "movie_id", "user_id"]
    placed = rows.withColumns({FILM_PARTS: F.lit(parts), FILM_PART: film_part(parts)})
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").partitionBy(FILM_PARTS, FILM_PART).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``new`` plus the rows of ``old`` whose key it does not replace.

    The last write wins: of rows of ``new`` with one key the one with the largest
    ``order`` stays; without ``order`` keys must not repeat.  ``order`` is not part of
    the result.  Write the result to a fresh path: ``old`` may be the table being replaced.
    """
    if order is not None:
        ties = [F.col(c) for c in sorted(set(new.columns) - {key, order})]
        latest = first_k(new, 1, key, [F.desc(order), *ties], "_place")
        new = latest.drop("_place", order)
    kept = lookup_join(old, new.select(key).distinct(), key, "left_anti", computed=True)
    return kept.unionByName(new)


PART = "key_part"


def _part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(PART)


def create_keyed_table(df: DataFrame, path: str, key: str, parts: int) -> None:
    """A table in ``parts`` folders by a hash of its key, for ``upsert_into``."""
    placed = df.withColumn(PART, _part_of(key, parts))
    placed.repartition(PART).write.partitionBy(PART).parquet(path)


def upsert_into(
    new: DataFrame, path: str, key: str, parts: int, order: str | None = None
) -> list[int]:
    """Merge ``new`` into the table at ``path``, rewriting only the folders its keys belong to.

    The table was made by ``create_keyed_table`` with as many ``parts``.  ``key`` and ``order``
    mean what they mean in ``upsert``.  Gives the numbers of the folders rewritten, at most
    ``parts`` of them.  The merged rows are stored before any folder is replaced.
    """
    spark = new.sparkSession
    stored = materialise(new.withColumn(PART, _part_of(key, parts)), "new-rows")
    touched = sorted(row[PART] for row in stored.select(PART).distinct().collect())
    if not touched:
        return []
    columns = [c for c in stored.columns if c != order]
    schema = T.StructType([f for f in stored.schema if f.name in columns])
    old = spark.read.schema(schema).parquet(path).filter(F.col(PART).isin(touched))
    merged = materialise(upsert(old.select(*columns), stored, key, order), "merged")
    merged.repartition(PART).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(PART).parquet(path)
    return touched
