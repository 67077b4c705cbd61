import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinerank.operators import splits
from cinerank.operators.ordinal import global_ordinal, group_ordinal
from cinerank.operators.topk import first_k
from tests.conftest import rows

ONCE_SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def frame(spark, users):
    """Rows (user, seq) with seq in an order unrelated to the row order."""
    data = [(user, (i * 7919) % 10007) for i, user in enumerate(users)]
    return spark.createDataFrame(data, "user int, seq int")


def expected_split(data, start, stop, max_test):
    """The reference semantics, row by row in file order."""
    seen, taken, test = {}, 0, set()
    for user, seq in sorted(data, key=lambda row: row[1]):
        seen[user] = seen.get(user, 0) + 1
        if (taken < max_test or max_test <= 0) and start <= seen[user] <= stop:
            taken += 1
            test.add((user, seq))
    return test


@ONCE_SLOW
@given(
    users=st.lists(st.integers(1, 4), min_size=1, max_size=60),
    start=st.integers(1, 4),
    length=st.integers(0, 5),
    max_test=st.sampled_from([-1, 0, 1, 3, 7, 1000]),
)
def test_split_nth_equals_row_by_row(spark, users, start, length, max_test):
    df = frame(spark, users)
    split = splits.split_nth_per_user(df, start, start + length, max_test, "user", "seq")
    data = rows(df)
    test = {row[:2] for row in rows(split, "user", "seq", "is_test") if row[2]}
    assert test == expected_split(data, start, start + length, max_test)
    assert rows(split, "user", "seq") == data


@pytest.mark.parametrize("n, k", [(23, 5), (20, 5), (3, 5), (1, 1)])
def test_folds_are_contiguous_and_even(spark, n, k):
    df = frame(spark, [1] * n)
    folds = splits.assign_folds(df, k, ["seq"])
    ordered = [row[1] for row in sorted(rows(folds, "seq", "fold"))]
    assert ordered == sorted(ordered)
    sizes = [ordered.count(i) for i in range(1, k + 1)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_fold_base_is_everything_else(spark):
    folds = splits.assign_folds(frame(spark, [1, 2, 3] * 9), 4, ["seq"])
    for i in range(1, 5):
        test, base = splits.fold_test(folds, i), splits.fold_base(folds, i)
        assert rows(test.unionByName(base)) == rows(folds)
        assert rows(splits.complement(folds, test)) == rows(base)
        assert rows(splits.anti_base(folds, test, ["seq"]), *base.columns) == rows(base)


def test_global_ordinal_counts_once_through(spark):
    df = frame(spark, [1, 2] * 50)
    numbered = rows(global_ordinal(df, ["seq"], partitions=7), "seq", "ordinal")
    assert [row[1] for row in sorted(numbered)] == list(range(1, 101))


def test_large_groups_are_numbered_by_range(spark):
    """One user holds most rows; both ways give the same numbers."""
    df = frame(spark, [1] * 90 + [2] * 5 + [3] * 25)
    small = group_ordinal(df, "user", "seq", window_rows=1000)
    large = group_ordinal(df, "user", "seq", window_rows=10)
    assert rows(small, "user", "seq", "ordinal") == rows(large, "user", "seq", "ordinal")


def test_first_k_cuts_groups_before_the_shuffle(spark):
    plan = first_k(frame(spark, [1] * 9), 3, "user", [F.col("seq")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("window_rows", [5, 1000])
def test_top_k_beyond_sparks_threshold(spark, monkeypatch, window_rows):
    """A k that Spark would not cut early gives the same rows, also for large groups."""
    df = frame(spark, [1] * 60 + [2] * 8)
    expected = rows(first_k(df, 20, "user", [F.desc("seq")]), "user", "seq", "rank")
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    monkeypatch.setattr(group_ordinal, "__defaults__", ("ordinal", window_rows))
    try:
        spark.conf.set(name, "10")
        found = first_k(df, 20, "user", [F.desc("seq")])
        assert rows(found, "user", "seq", "rank") == expected
    finally:
        spark.conf.set(name, before)


def test_slices_do_not_overlap(spark):
    df = frame(spark, [1] * 25)
    parts = [rows(splits.slice_rows(df, i, 10, ["seq"]), "seq") for i in (1, 2, 3, 4)]
    assert [len(part) for part in parts] == [10, 10, 5, 0]
    assert sorted(sum(parts, [])) == sorted(rows(df, "seq"))


def test_random_split_repeats_with_its_seed(spark):
    df = frame(spark, [1, 2, 3] * 30)
    first, second = splits.random_split(df, 0.8, 3), splits.random_split(df, 0.8, 3)
    assert [rows(part) for part in first] == [rows(part) for part in second]
    assert rows(first[0].unionByName(first[1])) == rows(df)


@pytest.mark.parametrize("window_rows", [5, 1000])
def test_group_ordinal_keeps_missing_groups(spark, window_rows):
    data = [(None if i % 3 == 0 else i % 3, i) for i in range(60)]
    frame = spark.createDataFrame(data, "g int, v int")
    numbered = group_ordinal(frame, "g", "v", window_rows=window_rows)
    expected = []
    for group in (None, 1, 2):
        members = sorted(v for g, v in data if g == group)
        expected += [(group, v, n) for n, v in enumerate(members, 1)]
    assert rows(numbered, "g", "v", "ordinal") == sorted(expected, key=repr)


def test_rank_has_one_type(spark):
    frame = spark.range(20).select((F.col("id") % 2).alias("g"), "id")
    small, large = (first_k(frame, k, "g", ["id"]) for k in (1000, 1001))
    assert small.schema == large.schema
    assert rows(small) == rows(large, *small.columns)
