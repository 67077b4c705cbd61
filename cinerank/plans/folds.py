"""Training and test tables as a job: disjoint folds, and rows held out per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.operators.splits import assign_folds, holdout_per_user
from cinerank.session import materialise

KEYS = ["user_id", "movie_id"]


def _write_sorted(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value of ``by``, its rows in order of user and film across its files."""
    stored = materialise(df, "split")
    stored.repartitionByRange(by, *KEYS).sortWithinPartitions(by, *KEYS).write.partitionBy(by).parquet(path)


def write_folds(ratings: DataFrame, path: str, k: int, seq: str) -> None:
    """Write every rating once, in the folder of its fold, sorted by user and film.

    Folds are slices of the order of ``seq``, which is unique.  A fold's base is the other
    folders, so nothing is written k times.
    """
    _write_sorted(assign_folds(ratings, k, [seq]), path, "fold")


def read_fold(spark: SparkSession, path: str, i: int, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Base and test of fold ``i``; only the folders concerned are read."""
    tagged = spark.read.schema(T.StructType([*schema, T.StructField("fold", T.IntegerType())]))
    rows = tagged.parquet(path)
    return rows.filter(F.col("fold") != i).drop("fold"), rows.filter(F.col("fold") == i).drop("fold")


def write_holdout(ratings: DataFrame, path: str, n: int, user: str, seq: str, block: int = 1) -> None:
    """Write every rating once, ``n`` test rows of each user apart from the rest, both sorted."""
    _write_sorted(holdout_per_user(ratings, n, user, seq, block), path, "is_test")


def read_holdout(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Base and test rows."""
    tagged = spark.read.schema(T.StructType([*schema, T.StructField("is_test", T.BooleanType())]))
    rows = tagged.parquet(path)
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


def export_split(base: DataFrame, test: DataFrame, path: str, name: str) -> None:
    """``name``.base and ``name``.test as tab-separated files without header, sorted by user and film."""
    for part, rows in (("base", base), ("test", test)):
        ordered = materialise(rows, part).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        ordered.write.csv(f"{path}/{name}.{part}", sep="\t", header=False)
