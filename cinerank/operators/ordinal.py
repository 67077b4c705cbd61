"""Row numbers over a whole table or a group, without one task seeing it all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.session import materialise

# A single window partition above this many rows is numbered by range instead.
WINDOW_ROWS = 2_000_000
_POSITION_BITS = 33


def global_ordinal(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "ordinal",
    partitions: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Number all rows 1..n in the order of ``order_by``, which must be unique.

    ``total`` names a column for n.  ``partitions`` defaults to the session's
    shuffle partitions.

    Rows are range-partitioned and sorted once; each partition numbers its own
    rows, and the partition sizes (one row each) give the offsets.  The sorted
    rows are written before the sizes are taken, so both reads agree on where
    each row is.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.col("_place")
    placed = materialise(
        df.repartitionByRange(partitions, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ordinal",
    ).withColumn("_part", F.shiftright(place, _POSITION_BITS).cast("int"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias(total or "_total"),
    )
    position = place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_part", "_offset", "_place", "_total")
    )


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    counts = df.groupBy(*group).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def group_ordinal(
    df: DataFrame,
    group: str | Sequence[str],
    order_by: str | Sequence[str | Column],
    name: str = "ordinal",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Number the rows of each group 1..n; ``order_by`` is unique within a group.

    Groups that fit one task use a window.  If any group is larger, the table
    is numbered by range over (group, order), which splits large groups over
    many tasks, and each group's first number is subtracted.
    """
    group = [group] if isinstance(group, str) else list(group)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    if largest_group(df, group) <= window_rows:
        window = Window.partitionBy(*group).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    numbered = global_ordinal(df, [*group, *order_by], "_overall")
    starts = numbered.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(
        F.min("_overall").alias("_start")
    )
    # A missing key is a group like any other.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("_overall") - F.col("_start") + 1)
        .drop("_overall", "_start", *[f"_of_{c}" for c in group])
    )
