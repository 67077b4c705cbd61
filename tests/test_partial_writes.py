"""Writes and sorts that touch only the part concerned; fits that spread a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinerank.operators import als, grouped_als, splits
from cinerank.operators.grouped_als import fit_factors
from cinerank.session import scratch_path
from cinerank.sinks.tables import create_keyed_table, upsert_into
from tests.conftest import rows


def files(spark, path):
    table = spark.read.parquet(path)
    return {tuple(r) for r in table.select("key_part", F.input_file_name()).distinct().collect()}


def test_untouched_folders_keep_their_files(spark):
    path = scratch_path(spark, "keyed")
    old = spark.range(400).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"))
    create_keyed_table(old, path, "k", 16)
    before = files(spark, path)
    new = [(5, "new", 1), (5, "newer", 2), (1000, "more", 1), (6, None, 1)]
    touched = upsert_into(spark.createDataFrame(new, "k int, v string, at int"), path, "k", 16, "at")
    assert 1 <= len(touched) <= 3
    after = files(spark, path)
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert not {f for f in before if f[0] in touched} & after
    stored = dict(rows(spark.read.parquet(path), "k", "v"))
    assert stored == {k: "old" for k in range(400)} | {5: "newer", 6: None, 1000: "more"}
    empty = spark.createDataFrame([], "k int, v string, at int")
    assert upsert_into(empty, path, "k", 16, "at") == [] and files(spark, path) == after


@pytest.mark.parametrize("i, n", [(1, 7), (3, 100), (5, 100), (6, 100), (1, 10_000), (2, 450)])
def test_slices_store_about_the_slice(spark, monkeypatch, i, n):
    table = [(None if k % 50 == 0 else k % 9, k, f"t{k}") for k in range(500)]
    frame = spark.createDataFrame(table, "a int, b int, c string").repartition(5)
    written = []
    plain = splits.global_ordinal
    monkeypatch.setattr(splits, "global_ordinal", lambda df, *rest: written.append(df.count()) or plain(df, *rest))
    found = splits.slice_rows(frame, i, n, ["a", "b"], partitions=20)
    ordered = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = [(*r, at) for at, r in enumerate(ordered, 1)][(i - 1) * n : i * n]
    assert rows(found, "a", "b", "c", "ordinal") == sorted(expected, key=repr)
    assert sum(written) <= min(len(expected) + 2 * 80, 500)


def plain_factors(ratings, rank, reg, rounds, start):
    """Alternating solves of each user's and film's own least squares."""
    users, items = {}, dict(start)
    for _ in range(rounds):
        for mine, other, at in ((users, items, 0), (items, users, 1)):
            for key in {r[at] for r in ratings}:
                held = [(other[r[1 - at]], r[2]) for r in ratings if r[at] == key]
                y = np.array([h[0] for h in held])
                system = y.T @ y + reg * len(held) * np.eye(rank)
                mine[key] = np.linalg.solve(system, y.T @ np.array([h[1] for h in held])).astype(np.float32).astype(float)
    return users, items


@pytest.fixture(scope="module")
def hot_film():
    """Everybody rates film 0; other films have a few ratings."""
    random = np.random.default_rng(4)
    pairs = {(u, 0) for u in range(60)} | {(int(u), int(f)) for u, f in random.integers(0, [60, 25], (400, 2))}
    return [(u, f, float(1 + (u * 3 + f * 5) % 5)) for u, f in sorted(pairs)]


def test_grouped_equations_equal_plain_solves(spark, hot_film):
    frame = spark.createDataFrame(hot_film, "user_id int, movie_id int, rating double").repartition(7)
    films = frame.select(F.col("movie_id").alias("id")).distinct()
    start = {r["id"]: np.array(r["features"], float) for r in grouped_als._start(films, 3, 11).collect()}
    expected = plain_factors(hot_film, 3, 0.1, 4, start)
    for limit in (1 << 30, 1):
        found = fit_factors(frame, 3, 4, 0.1, 11, limit)
        for side, plain in zip(found, expected):
            got = {r["id"]: np.array(r["features"]) for r in side.collect()}
            assert got.keys() == plain.keys()
            assert all(np.allclose(got[k], plain[k], atol=2e-3) for k in plain)


def test_a_hot_film_is_summed_before_the_shuffle(spark, hot_film):
    frame = spark.createDataFrame(hot_film, "user_id int, movie_id int, rating double").repartition(7)
    users = grouped_als._start(frame.select(F.col("user_id").alias("id")).distinct(), 3, 1)
    sums = grouped_als.normal_equations(frame, "movie_id", "user_id", users, 3, 0, 1 << 30)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    sides = plan[: plan.index("Exchange")], plan[plan.index("Exchange") :]
    assert "HashAggregate(keys=[movie_id" in sides[0] and "partial_sum" in sides[1]
    assert {r["id"]: r["n"] for r in sums.collect()}[0] == 60


def test_equations_of_few_ratings_are_not_sent(spark, hot_film, monkeypatch):
    """Only hot keys are summed by Spark; the others' ratings and factors meet in a task."""
    frame = spark.createDataFrame(hot_film, "user_id int, movie_id int, rating double").repartition(7)
    films = frame.select(F.col("movie_id").alias("id")).distinct()
    start = {r["id"]: np.array(r["features"], float) for r in grouped_als._start(films, 3, 11).collect()}
    expected = plain_factors(hot_film, 3, 0.1, 4, start)
    summed = []
    plain = grouped_als.normal_equations

    def counted(pairs, key, *args):
        summed.append((key, pairs.select(key).distinct().count()))
        return plain(pairs, key, *args)

    monkeypatch.setattr(grouped_als, "normal_equations", counted)
    monkeypatch.setattr(grouped_als, "LEAST_TASKS", 3)
    monkeypatch.setattr(grouped_als, "SOLVE_ROWS", 10)
    for hot_rows, keys in ((1 << 20, []), (60, [("movie_id", 1)] * 4)):
        summed.clear()
        found = fit_factors(frame, 3, 4, 0.1, 11, hot_rows=hot_rows)
        assert summed == keys
        for side, by_hand in zip(found, expected):
            got = {r["id"]: np.array(r["features"]) for r in side.collect()}
            assert got.keys() == by_hand.keys()
            assert all(np.allclose(got[k], by_hand[k], atol=2e-3) for k in by_hand)


def test_grouped_model_is_a_model_of_the_same_form(spark, hot_film):
    frame = spark.createDataFrame(hot_film, "user_id int, movie_id int, rating int".replace("rating int", "rating double"))
    grouped = als.fit(frame, seed=3, rank=4, max_iter=8, method="grouped")
    blocks = als.fit(frame, seed=3, rank=4, max_iter=8)
    path = scratch_path(spark, "model")
    als.save(grouped, path)
    again = als.load(path)
    assert again.rank == 4 and again.getColdStartStrategy() == "drop"

    def error(model):
        held = als.predict(model, frame)
        return held.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2))).first()[0]

    # Different starts, the same objective: both end about as far from the ratings.
    assert abs(error(again) - error(blocks)) < 0.1
    assert als.recommend_all(again, 3).count() == 180
    unknown = spark.createDataFrame([(999, 0, 1.0), (0, 999, 1.0)], "user_id int, movie_id int, rating double")
    assert als.predict(again, unknown).count() == 0
    with pytest.raises(ValueError):
        als.fit(frame, method="other")
