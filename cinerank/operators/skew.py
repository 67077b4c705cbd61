"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.session import materialise

BROADCAST_LIMIT = 64 * 1024 * 1024
HOT_ROWS = 1_000_000


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _value_bytes(field: T.StructField) -> Column | None:
    """Bytes of a variable-length column, None for fixed-width ones."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    if isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, T.NumericType
    ):
        return F.size(column) * 8
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.octet_length(F.to_json(column))
    return None


def _total_bytes(df: DataFrame) -> Column:
    sizes = [size for size in map(_value_bytes, df.schema.fields) if size is not None]
    per_row = reduce(
        lambda total, size: total + F.coalesce(size, F.lit(0)).cast("long"),
        sizes,
        F.lit(16 * len(df.columns)).cast("long"),
    )
    return F.sum(per_row)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, measured by one aggregate over them."""
    return df.agg(_total_bytes(df)).first()[0] or 0


def materialise_measured(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` once and learn the size of its rows from the same job."""
    seen = Observation()
    stored = materialise(df.observe(seen, _total_bytes(df).alias("bytes")), label)
    return stored, seen.get.get("bytes") or 0


def hot_keys(df: DataFrame, on: str | Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with at least ``hot_rows`` rows, and their number as ``_rows``.

    Rows are counted on the map side first.  There are at most as many such keys
    as ``hot_rows`` goes into the number of rows.
    """
    counts = df.groupBy(*_keys(on)).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") >= hot_rows)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join with each hot key of ``left`` spread over tasks of ``hot_rows`` rows.

    Only the ``right`` rows of hot keys are repeated, once per salt.  Where there
    are hot keys, ``left`` is stored with a number for each row, which the salt
    is taken from: rows that are equal in all columns spread too, and a retried
    task sends each row to the same place.  Rows with a missing key match
    nothing and are not shuffled.  ``how`` is inner, left, left_semi or left_anti.
    ``counted`` has at least the keys of ``left``, as often, and costs less to read: hot
    keys are counted there.
    """
    keys = _keys(on)
    missing = reduce(or_, [F.col(f"`{c}`").isNull() for c in keys])
    whole = left.filter(~missing)
    hot, size = materialise_measured(
        hot_keys(whole if counted is None else counted.dropna(subset=keys), keys, hot_rows), "hot-keys"
    )
    if hot.isEmpty():
        joined = whole.join(right, keys, how)
    else:
        hot = hot.select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
        if size <= BROADCAST_LIMIT:
            hot = F.broadcast(hot)
        numbered = materialise(
            whole.withColumn("_row", F.monotonically_increasing_id()), "salted"
        )
        salts = F.coalesce("_salts", F.lit(1))
        left_salted = (
            numbered.join(hot, keys, "left")
            .withColumn("_salt", F.pmod(F.xxhash64("_row"), salts).cast("int"))
            .drop("_salts", "_row")
        )
        right_salted = (
            right.join(hot, keys, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("_salts")
        )
        joined = left_salted.join(right_salted, [*keys, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(left.filter(missing), allowMissingColumns=True)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_LIMIT,
    computed: bool = False,
) -> DataFrame:
    """Join against a side that is usually small.

    ``right`` is broadcast when its measured size is within ``limit``; beyond
    that both sides are shuffled, with the hot keys of ``left`` salted.
    ``computed`` says that ``right`` costs work to produce: it is then written
    once, so that measuring it does not repeat the work.
    """
    if computed:
        right, size = materialise_measured(right, "lookup")
    else:
        size = measured_bytes(right)
    return sized_join(left, right, on, size, how, limit)


def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    size: int,
    how: str = "inner",
    limit: int = BROADCAST_LIMIT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``lookup_join`` for a ``right`` side that has been measured already."""
    if size <= limit:
        return left.join(F.broadcast(right), _keys(on), how)
    return salted_join(left, right, on, how, counted=counted)
