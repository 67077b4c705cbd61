"""Helpers shared by the operators of this package.

Every operator selects the columns it needs by name first, so further columns of
its input, whatever they are called, neither reach nor disturb it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stands for a missing doc_id where ids are ordered: before all others.
NO_ID = -(1 << 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> Column:
    """64 bits of hash that tell texts with one doc_id, or with none, apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """``did`` and ``tk`` name a document inside a job, ``text`` is never null.

    A row that repeats both doc_id and text is the same document; a row that
    repeats only the doc_id is another one.
    """
    return docs.select(
        id_key().alias("did"), text_key().alias("tk"), F.coalesce("text", F.lit("")).alias("text")
    )


def real_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NO_ID, F.col(did))


def crc_slot(modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=field.type) for c, field in zip(columns, schema, strict=True)],
        schema=schema,
    )


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n, size or 0


def parts_for(amount: int, each: int) -> int:
    return max(1, math.ceil(amount / each))
