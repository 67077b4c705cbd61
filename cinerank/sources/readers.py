"""Scans.  Schemas are declared, so no read costs an inference pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.sources import schemas


def read_movies(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Pipe-separated item file, ISO-8859-1, no header."""
    return spark.read.csv(path, sep="|", schema=schemas.MOVIES, encoding="ISO-8859-1")


def read_ratings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated rating file or list of files (fold files give the full set)."""
    return spark.read.csv(path, sep="\t", schema=schemas.RATINGS)


def read_users(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Pipe-separated user file, no header."""
    return spark.read.csv(path, sep="|", schema=schemas.USERS)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV directory with a header line in each part."""
    return spark.read.csv(path, header=True, schema=schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, the canonical form: columns and filters reach the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def requests_frame(
    spark: SparkSession, keys: Iterable | DataFrame, name: str, dtype: T.DataType
) -> DataFrame:
    """Request keys as a one-column DataFrame, one row per key.

    Few keys may come from the caller as values, many as a table of one column.
    """
    if isinstance(keys, DataFrame):
        return rename_by_position(keys, [name]).select(F.col(name).cast(dtype))
    schema = T.StructType([T.StructField(name, dtype)])
    return spark.createDataFrame([(key,) for key in keys], schema)


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise FileNotFoundError naming every path Spark cannot find.

    The text reader resolves the path on whatever filesystem it names and
    needs no schema, so the check starts no job.
    """
    missing = []
    for path in paths:
        try:
            spark.read.text(path).schema
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))
