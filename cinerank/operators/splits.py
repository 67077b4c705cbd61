"""Training and test splits that give the same rows on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.operators.ordinal import WINDOW_ROWS, global_ordinal, group_ordinal
from cinerank.operators.skew import lookup_join
from cinerank.operators.topk import first_k


def running_count(
    df: DataFrame, user: str, seq: str, name: str = "ordinal", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """How many of the user's rows have been seen so far, in the order of ``seq``."""
    return group_ordinal(df, user, seq, name, window_rows)


def split_nth_per_user(
    df: DataFrame, start: int, stop: int, max_test: int, user: str, seq: str
) -> DataFrame:
    """Add ``is_test``: the user's rows number ``start`` to ``stop`` in ``seq`` order.

    With ``max_test`` > 0 only the first ``max_test`` such rows of the whole
    table, in ``seq`` order, are test rows.  ``seq`` is unique.

    The test rows of a user are consecutive, so two bounds per user say it all:
    only ``stop`` rows per user are ranked, and the table itself is joined once.
    """
    eligible = (
        first_k(df.select(user, seq), stop, user, [F.col(seq)], "_nth")
        .filter(F.col("_nth") >= start)
        .select(user, seq)
    )
    if 0 < max_test < eligible.count():
        numbered = global_ordinal(eligible, [seq], "_overall")
        eligible = numbered.filter(F.col("_overall") <= max_test).select(user, seq)
    bounds = eligible.groupBy(user).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"))
    inside = F.col(seq).between(F.col("_first"), F.col("_last"))
    return (
        lookup_join(df, bounds, user, "left", computed=True)
        .withColumn("is_test", F.coalesce(inside, F.lit(False)))
        .drop("_first", "_last")
    )


def holdout_per_user(df: DataFrame, n: int, user: str, seq: str, block: int = 1) -> DataFrame:
    """``n`` test rows per user: the ``block``-th run of ``n`` rows in ``seq`` order."""
    return split_nth_per_user(df, (block - 1) * n + 1, block * n, 0, user, seq)


def _ranges(df: DataFrame, order_by: Sequence[str], partitions: int) -> list:
    """First and last key and number of rows of ranges that follow each other."""
    key = F.struct(*order_by)
    return sorted(
        df.select(*order_by)
        .repartitionByRange(partitions, *order_by)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
        .collect(),
        key=lambda row: row["part"],
    )


def slice_rows(
    df: DataFrame, i: int, n: int, order_by: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Rows (i-1)*n+1 to i*n of the table in the order of ``order_by``, which is unique.

    The keys alone are counted by range, in ``partitions`` ranges (the session's shuffle
    partitions unless given), of which the driver sees the bounds.  Only the rows of
    the ranges that the slice meets are sorted and stored.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before, met = 0, []
    low, high = (i - 1) * n, i * n
    for part in _ranges(df, order_by, partitions):
        if before < high and before + part["n"] > low:
            met.append((before, part))
        before += part["n"]
    if not met:
        return df.withColumn("ordinal", F.lit(None).cast("long")).filter(F.lit(False))
    key = F.struct(*order_by)
    kind = df.select(key.alias("key")).schema["key"].dataType
    spark = df.sparkSession
    # Bounds as a row of one table: any type of key travels as it is.
    bounds = spark.createDataFrame(
        [(met[0][1]["first"], met[-1][1]["last"])],
        T.StructType([T.StructField("_low", kind), T.StructField("_high", kind)]),
    )
    concerned = (
        df.join(F.broadcast(bounds), (key >= F.col("_low")) & (key <= F.col("_high")))
        .drop("_low", "_high")
    )
    ordinal = F.col("ordinal")
    numbered = global_ordinal(concerned, order_by).withColumn("ordinal", ordinal + met[0][0])
    return numbered.filter((ordinal > low) & (ordinal <= high))


def assign_folds(df: DataFrame, k: int, order_by: Sequence[str]) -> DataFrame:
    """Add ``fold`` 1..k: contiguous slices of the order, sizes differing by at most one."""
    numbered = global_ordinal(df, order_by, total="_n")
    index = F.col("ordinal") - 1
    small = F.expr(f"_n div {k}")
    larger = F.expr(f"_n % {k}")
    # The first `larger` folds take one row more than the rest.
    boundary = larger * (small + 1)
    fold = F.when(index < boundary, F.floor(index / (small + 1))).otherwise(
        larger + F.floor((index - boundary) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn("fold", (fold + 1).cast("int")).drop("_n", "ordinal")


def fold_test(folds: DataFrame, i: int) -> DataFrame:
    return folds.filter(F.col("fold") == i)


def fold_base(folds: DataFrame, i: int) -> DataFrame:
    """Rows before the fold together with the rows after it."""
    return folds.filter(F.col("fold") < i).unionByName(folds.filter(F.col("fold") > i))


def complement(df: DataFrame, test: DataFrame) -> DataFrame:
    """All rows except the test rows, counting repeats."""
    return df.exceptAll(test)


def anti_base(df: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``test``.  Test keys are made distinct before the join."""
    return lookup_join(df, test.select(*keys).distinct(), keys, "left_anti", computed=True)


def random_split(df: DataFrame, train: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Seeded random split into ``train`` and the rest.

    The draw is a hash of the seed and the row, so a row falls on the same side
    whatever the partitioning, also when a lost task is run again, and neither
    part needs a sort or a copy.  Equal rows stay together.
    """
    steps = 1 << 20
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(steps))
    inside = draw < int(train * steps)
    return df.filter(inside), df.filter(~inside)


def is_training_key(user: Column, item: Column, train_tenths: int = 8) -> Column:
    """A split that depends on the two keys alone, by plain arithmetic."""
    mixed = user.cast("long") * 31 + item.cast("long")
    return F.pmod(mixed, F.lit(10)) < train_tenths


def sort_user_item(df: DataFrame, user: str = "user_id", item: str = "movie_id") -> DataFrame:
    """Total order by (user, item) through a range shuffle."""
    return df.orderBy(user, item)
