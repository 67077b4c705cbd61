import pytest
from pyspark.sql import functions as F

from cinerank.operators.skew import (
    hot_keys,
    lookup_join,
    materialise_measured,
    measured_bytes,
    salted_join,
)
from cinerank.session import scratch_root, spread
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """900 rows of which a third carry key 0; key 99 is unknown to the other side."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, 99)
    return spark.range(900).select(
        key.otherwise(F.col("id") % 7 + 1).cast("int").alias("key"), F.col("id").alias("value")
    )


@pytest.fixture(scope="module")
def names(spark):
    return spark.range(12).select(
        F.col("id").cast("int").alias("key"), F.concat(F.lit("n"), "id").alias("name")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(hot, names, how):
    salted = salted_join(hot, names, "key", how, hot_rows=50)
    assert rows(salted) == rows(hot.join(names, "key", how), *salted.columns)


def test_salted_join_keeps_repeats_on_the_right(hot, names):
    twice = names.unionByName(names)
    salted = salted_join(hot, twice, "key", hot_rows=50)
    assert rows(salted) == rows(hot.join(twice, "key"), *salted.columns)


def test_hot_keys_finds_the_large_key(hot):
    assert rows(hot_keys(hot, "key", hot_rows=200)) == [(0, 300)]


def test_lookup_join_has_a_way_beyond_the_limit(hot, names):
    expected = rows(hot.join(names, "key", "left"))
    for limit in (0, 1 << 30):
        for computed in (False, True):
            joined = lookup_join(hot, names, "key", "left", limit=limit, computed=computed)
            assert rows(joined) == expected


def test_broadcast_only_within_the_limit(hot, names):
    def plan(limit):
        joined = lookup_join(hot, names, "key", limit=limit)
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(1 << 30)
    assert "strategy=broadcast" not in plan(0)


def parts_of(frame, condition):
    """Tasks of the join that hold rows of ``condition``."""
    placed = frame.withColumn("_part", F.spark_partition_id()).filter(condition)
    return placed.select("_part").distinct().count()


def test_rows_that_are_all_alike_spread(spark, names):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = spark.range(9000).select((F.col("id") % 10 * 0).cast("int").alias("key"))
        joined = salted_join(keys, names.hint("merge"), "key", "left_semi", hot_rows=100)
        assert joined.count() == 9000
        assert parts_of(joined, "key = 0") > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot_rows", [50, 10_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_missing_keys_match_nothing_and_stay_where_they_are(spark, names, how, hot_rows):
    key = F.when(F.col("id") % 2 == 0, F.col("id") % 3).cast("int")
    left = spark.range(0, 900, 1, 6).select(key.alias("key"), F.col("id").alias("value"))
    joined = salted_join(left, names, "key", how, hot_rows=hot_rows)
    assert rows(joined) == rows(left.join(names, "key", how), *joined.columns)
    if how in ("left", "left_anti"):
        assert parts_of(joined, "key IS NULL") > 1


def test_sizes_grow_with_text_and_agree(spark):
    short = spark.createDataFrame([("a",)], "t string")
    long = spark.createDataFrame([("a" * 1000, )], "t string")
    assert measured_bytes(long) - measured_bytes(short) == 999
    assert materialise_measured(long, "sizes")[1] == measured_bytes(long)
    assert measured_bytes(short.filter("t = 'b'")) == 0


class _Cluster:
    """A session that is not local and names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "yarn"


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(_Cluster)


def test_small_inputs_are_spread_over_the_cores(spark):
    one = spark.range(100).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(one, "id").rdd.getNumPartitions() == cores
    assert rows(spread(one, "id")) == rows(one)
