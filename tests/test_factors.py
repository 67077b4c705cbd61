import numpy as np
import pytest
from pyspark.sql import functions as F

from cinerank.operators import factors
from cinerank.operators.evaluate import rmse
from cinerank.operators.factors import (
    nearest_vectors,
    predict_pairs,
    recommendation_lists,
    top_k_items,
)
from tests.conftest import rows


def factor_frame(spark, matrix, first=0):
    data = [(first + i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, "id int, features array<float>")


def brute_force(users, items, k):
    scores = np.round(users.astype(np.float64) @ items.astype(np.float64).T, 6)
    result = []
    for u, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        result += [(u, i, float(row[i]), rank) for rank, i in enumerate(order, 1)]
    return sorted(result, key=repr)


@pytest.fixture(scope="module")
def matrices():
    random = np.random.default_rng(5)
    users = random.normal(size=(40, 6)).astype(np.float32)
    items = (random.normal(size=(300, 6)) * random.uniform(0.1, 3, (300, 1))).astype(np.float32)
    items[50:60] = items[40]  # equal scores, ties go to the smaller id
    users[7] = 0.0  # every score ties
    return users, items


@pytest.mark.parametrize("limit, block", [(1 << 30, 100_000), (3000, 37), (1, 1000)])
def test_top_k_is_exact_with_and_beyond_the_broadcast(spark, matrices, limit, block):
    users, items = matrices
    found = top_k_items(
        factor_frame(spark, users), factor_frame(spark, items), 10, limit, block
    )
    got = rows(found, "user_id", "movie_id", "score", "rank")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in brute_force(users, items, 10)]


def clustered(seed, n, width=16, clusters=60, spread=0.08):
    """Unit vectors around random directions; norms say nothing about them."""
    random = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(clusters, width))
    vectors = centres[random.integers(0, clusters, n)] + spread * random.normal(size=(n, width))
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def test_most_blocks_of_unit_vectors_are_skipped(spark, monkeypatch):
    users, items = clustered(2, 150), clustered(3, 3000)
    seen = []
    plain = factors.pivot_visits

    def counted(users, blocks, *rest):
        visits = plain(users, blocks, *rest)
        seen.append((visits.count(), users.count() * blocks.select("block").distinct().count()))
        return visits

    monkeypatch.setattr(factors, "pivot_visits", counted)
    found = top_k_items(factor_frame(spark, users), factor_frame(spark, items), 10, 1, 25)
    users, items = users.astype(np.float32), items.astype(np.float32)
    got = rows(found, "user_id", "movie_id", "score", "rank")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in brute_force(users, items, 10)]
    assert len(seen) == 2 and seen[0][1] >= 150 * 60
    assert sum(visits for visits, _ in seen) < 0.1 * seen[0][1]


def test_bounds_hold_for_obtuse_angles_and_no_length(spark):
    """All products are negative or zero; the best items are short, far off or of no length."""
    random = np.random.default_rng(8)
    users = -np.abs(random.normal(size=(12, 4)))
    items = np.abs(random.normal(size=(200, 4))) * random.uniform(0.01, 50, (200, 1))
    items[[17, 90]] = 0.0
    users[3] = 0.0
    found = top_k_items(factor_frame(spark, users), factor_frame(spark, items), 5, 1, 13)
    expected = brute_force(users.astype(np.float32), items.astype(np.float32), 5)
    got = rows(found, "user_id", "movie_id", "score", "rank")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in expected]


def test_vectors_of_different_lengths_are_refused(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, features array<float>")
    users = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "id int, features array<float>")
    for limit in (1 << 30, 1):
        with pytest.raises(Exception, match="vectors of"):
            top_k_items(users.coalesce(1), items, 1, limit).collect()


def test_small_tables_are_scored_by_many_tasks(spark, matrices, monkeypatch):
    monkeypatch.setattr(factors, "PRODUCTS_PER_TASK", 10_000)
    users, items = factor_frame(spark, matrices[0]).coalesce(1), factor_frame(spark, matrices[1])
    scored = factors._score_against(factors._with_norm(users), factors._with_norm(items), 3, 6)
    assert scored.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3


def test_fewer_items_than_k(spark, matrices):
    users, items = matrices
    found = top_k_items(factor_frame(spark, users[:3]), factor_frame(spark, items[:4]), 10)
    assert found.count() == 12


def test_no_items_no_rows(spark, matrices):
    items = factor_frame(spark, matrices[1]).filter("id < 0")
    assert top_k_items(factor_frame(spark, matrices[0]), items, 10).count() == 0


def test_lists_are_in_rank_order(spark, matrices):
    users, items = matrices
    lists = recommendation_lists(
        top_k_items(factor_frame(spark, users), factor_frame(spark, items), 10)
    )
    assert dict(lists.dtypes)["recommendations"] == "array<struct<movie_id:int,rating:float>>"
    for row in lists.collect():
        ratings = [entry["rating"] for entry in row["recommendations"]]
        assert ratings == sorted(ratings, reverse=True) and len(ratings) == 10


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_nearest_vectors(spark, matrices, metric):
    users, items = matrices
    users, items = users[:7].astype(float), items[:40].astype(float)
    if metric == "dot":
        score = users @ items.T
    elif metric == "cosine":
        score = (users @ items.T) / np.outer(
            np.linalg.norm(users, axis=1), np.linalg.norm(items, axis=1)
        )
    else:
        score = -np.linalg.norm(users[:, None] - items[None], axis=2)
    expected = sorted(
        (u, int(i), rank)
        for u in range(len(users))
        for rank, i in enumerate(np.argsort(-score[u], kind="stable")[:5], 1)
    )
    found = nearest_vectors(factor_frame(spark, users), factor_frame(spark, items), 5, metric)
    assert sorted(rows(found, "user_id", "movie_id", "rank")) == expected


def test_identical_vectors_are_at_distance_zero(spark, matrices):
    vectors = factor_frame(spark, matrices[0][:5])
    found = nearest_vectors(vectors, vectors, 1, "l2")
    assert rows(found, "user_id", "movie_id", "distance") == [(i, i, 0.0) for i in range(5)]


def test_equal_distances_go_by_id(spark):
    """Twelve vectors at distance 1, closer by less than the rounding in reverse order."""
    around = [
        [float(np.cos(a)) * (1 + 1e-9 * i), float(np.sin(a)) * (1 + 1e-9 * i)]
        for i, a in enumerate(np.linspace(0, 6, 12))
    ][::-1]
    frame = spark.createDataFrame(list(enumerate(around, 1)), "id int, features array<double>")
    query = spark.createDataFrame([(100, [0.0, 0.0])], "id int, features array<double>")
    found = nearest_vectors(query, frame, 3, "l2")
    assert rows(found, "rank", "movie_id", "distance") == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_cold_pairs_are_dropped(spark, matrices):
    users, items = matrices
    pairs = spark.createDataFrame([(1, 2, 3), (1, 9999, 3), (9999, 2, 3)], "user_id int, movie_id int, rating int")
    for rank in (None, 6):
        predicted = predict_pairs(pairs, factor_frame(spark, users), factor_frame(spark, items), rank)
        [row] = predicted.collect()
        assert row["prediction"] == pytest.approx(float(users[1] @ items[2]), abs=1e-5)


def test_rmse(spark):
    df = spark.createDataFrame([(1, 2.0), (5, 1.0), (3, 3.0)], "rating int, prediction double")
    row = rmse(df).first()
    assert row["rmse"] == pytest.approx((17 / 3) ** 0.5) and row["n_pairs"] == 3
    assert rmse(df.filter(F.lit(False))).first()["rmse"] is None


def test_a_vector_is_sent_to_few_blocks(spark, matrices, monkeypatch):
    """Items beyond the broadcast: a user visits blocks, not each pivot's items."""
    users, items = matrices
    visits = []
    plain = factors.pivot_visits

    def counted(*args):
        found = plain(*args)
        visits.append(found.count())
        return found

    monkeypatch.setattr(factors, "pivot_visits", counted)
    found = top_k_items(factor_frame(spark, users), factor_frame(spark, items), 10, 1, 100)
    assert found.count() == 400 and sum(visits) <= 40 * 3


def test_nearest_vectors_beyond_the_broadcast(spark, matrices, monkeypatch):
    """Distances of copies and of far vectors, found with short numbers first, are exact."""
    users, items = (m.astype(float) for m in matrices)
    items = np.concatenate([items, items[:50], 1e6 + items[50:60]])
    monkeypatch.setattr(factors, "BROADCAST_LIMIT", 1)
    found = nearest_vectors(factor_frame(spark, users), factor_frame(spark, items), 5, "l2")
    apart = users.astype(np.float32)[:, None].astype(float) - items.astype(np.float32)[None].astype(float)
    distance = np.round(np.sqrt((apart**2).sum(axis=2)), 6)
    expected = [
        (u, int(i), float(distance[u, i]), rank)
        for u in range(len(users))
        for rank, i in enumerate(np.argsort(distance[u], kind="stable")[:5], 1)
    ]
    assert rows(found, "user_id", "movie_id", "distance", "rank") == sorted(expected, key=repr)


def test_pairs_are_made_once_where_factors_are_shuffled(spark, matrices, monkeypatch):
    """Hot keys are counted on stored pairs, not on what makes them or on rows with vectors."""
    monkeypatch.setattr(factors, "BROADCAST_LIMIT", 1)
    monkeypatch.setattr("cinerank.operators.skew.sized_join.__defaults__", ("inner", 1, None))
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pairs = spark.range(200).selectExpr("int(id % 40) user_id", "int(id) movie_id")
    pairs = pairs.mapInArrow(count, pairs.schema)
    users, items = factor_frame(spark, matrices[0]), factor_frame(spark, matrices[1])
    assert predict_pairs(pairs, users, items).count() == 200 and made.value == 200


def test_blocks_grow_before_there_are_many(spark, matrices, monkeypatch):
    """A user's vector goes to each block it visits, so more items are not at once more blocks."""
    monkeypatch.setattr(factors, "BLOCK_NUMBERS", 60)
    items = factors._with_norm(factor_frame(spark, matrices[1]))
    blocks, _ = factors._blocks_of(items, None)
    assert blocks.select("block").distinct().count() == 8 and blocks.count() == 300
    monkeypatch.setattr(factors, "MOST_BLOCK_NUMBERS", 120, raising=False)
    blocks, _ = factors._blocks_of(items, None)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 20


def test_copies_of_items_do_not_grow_with_users(spark, matrices, monkeypatch):
    """Ten times the users, the same copies of each block; the answers stay exact."""
    users, items = matrices
    more = np.concatenate([users] * 10)
    copies, plain = [], factors.materialise

    def counted(df, label):
        stored = plain(df, label)
        if label == "visitors":
            copies.append(stored.agg(F.sum("salts"), F.count("*")).first())
        return stored

    monkeypatch.setattr(factors, "materialise", counted)
    monkeypatch.setattr(factors, "PRODUCTS_PER_VISIT", 1)
    monkeypatch.setattr(factors, "GROUP_NUMBERS", 24, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = top_k_items(factor_frame(spark, more), factor_frame(spark, items), 10, 1, 60)
        got = rows(found, "user_id", "movie_id", "score", "rank")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in brute_force(more, items, 10)]
    assert len(copies) == 2 and all(n <= 32 + blocks for n, blocks in copies)


def test_blocks_are_made_without_sorting_vectors(spark, matrices, monkeypatch):
    """Keys alone are sorted and stored again; blocks are runs of their order, of one size."""
    stored, plain = [], factors.materialise

    def counted(df, label):
        stored.append((label, "features" in df.columns))
        return plain(df, label)

    monkeypatch.setattr(factors, "materialise", counted)
    monkeypatch.setattr("cinerank.operators.ordinal.materialise", counted)
    items = np.concatenate([matrices[1], np.zeros((20, 6), np.float32)])
    blocks, _ = factors._blocks_of(factors._with_norm(factor_frame(spark, items)), 37)
    assert [label for label, vectors in stored if vectors] == ["cells"] and len(stored) == 2
    got = sorted(tuple(row) for row in blocks.select("cell", "band", "angle", "id", "block").collect())
    assert [row[-1] for row in got] == [i * 9 // 320 for i in range(320)]


def test_vectors_just_beyond_the_broadcast_are_copied_less(spark):
    """Copies of an item are as many as tasks a block: few items are dealt to four blocks, not two."""
    items = spark.range(120_000).select(
        F.col("id").cast("int"), F.array_repeat(F.rand(1).cast("float"), 64).alias("features")
    )
    blocks, pivots = factors._blocks_of(factors._with_norm(items), None)
    visits = blocks.select("id", "block")
    crowds = factors._crowds(visits, blocks, pivots.shape[1])
    assert crowds.agg(F.max("salts")).first()[0] == 1


def test_both_passes_share_the_tasks_and_store_no_lists_of_visits(spark, matrices, monkeypatch):
    """A part of the pairs gets that part of the tasks, and with it of the copies of blocks."""
    users, items = matrices
    more = np.concatenate([users] * 10)
    copies, stored, plain = [], {}, factors.materialise

    def counted(df, label):
        written = plain(df, label)
        stored[label] = written.count()
        if label == "visitors":
            copies.append(written.agg(F.sum("salts"), F.count("*")).first())
        return written

    monkeypatch.setattr(factors, "materialise", counted)
    monkeypatch.setattr(factors, "PRODUCTS_PER_VISIT", 1)
    found = top_k_items(factor_frame(spark, more), factor_frame(spark, items), 10, 1, 60)
    got = rows(found, "user_id", "movie_id", "score", "rank")
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in brute_force(more, items, 10)]
    cores = spark.sparkContext.defaultParallelism
    tasks = max(factors.VISIT_TASKS, 2 * cores)
    assert sum(n for n, _ in copies) <= tasks + cores + sum(blocks for _, blocks in copies)
    assert stored["ranked"] == 4000 and stored["floors"] <= 400 and "scores" not in stored


def test_lists_longer_than_spark_cuts_are_exact_beyond_the_broadcast(spark, matrices):
    users, items = matrices
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        found = top_k_items(factor_frame(spark, users), factor_frame(spark, items), 5, 1, 60)
        got = rows(found, "user_id", "movie_id", "score", "rank")
    finally:
        spark.conf.set(name, before)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in brute_force(users, items, 5)]


def test_pairs_meet_vectors_without_carrying_them(spark, matrices, monkeypatch):
    """Beyond the broadcast no pair is joined to a vector that it takes through the next shuffle."""
    users, items = (factor_frame(spark, m) for m in matrices)
    asked = [(u, i, f"{u}-{i}", u / 3) for u in range(45) for i in range(0, 310, 7)] + [(1, 2, None, None)] * 3
    pairs = spark.createDataFrame([*asked, (None, 3, "x", 0.5)], "user_id int, movie_id long, t string, w double")
    expected = {rank: predict_pairs(pairs, users, items, rank) for rank in (None, 6)}
    expected = {rank: (frame.columns, rows(frame)) for rank, frame in expected.items()}
    assert len(expected[6][1]) == 40 * 43 + 3

    def joined(*args, **kwargs):
        raise AssertionError("pairs are joined to vectors")

    monkeypatch.setattr(factors, "BROADCAST_LIMIT", 1)
    monkeypatch.setattr(factors, "sized_join", joined)
    for rank, (columns, found) in expected.items():
        frame = predict_pairs(pairs, users, items, rank)
        assert frame.columns == columns and rows(frame) == found


def test_ids_that_repeat_meet_as_in_a_join(spark, monkeypatch):
    vectors = [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (2, [0.5, 0.0])]
    frame = spark.createDataFrame(vectors, "id int, features array<float>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "user_id int, movie_id int")
    expected = rows(predict_pairs(pairs, frame, frame))
    assert len(expected) == 4 + 2 + 1
    monkeypatch.setattr(factors, "BROADCAST_LIMIT", 1)
    assert rows(predict_pairs(pairs, frame, frame)) == expected


def test_vectors_that_are_not_alike_are_joined(spark, monkeypatch):
    """A missing or shorter vector gives a missing prediction, as within the broadcast."""
    users = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, features array<float>")
    items = spark.createDataFrame([(7, [2.0, 1.0])], "id int, features array<float>")
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "user_id int, movie_id int")
    expected = rows(predict_pairs(pairs, users, items))
    monkeypatch.setattr(factors, "BROADCAST_LIMIT", 1)
    assert rows(predict_pairs(pairs, users, items)) == expected


def test_pieces_of_a_block_are_narrow_and_their_bounds_hold():
    """Few items of a block are tried for a user whose best scores are known; none is missed."""
    import pyarrow as pa

    random = np.random.default_rng(12)
    items = random.normal(size=(40_000, 8)) + 0.5
    items[:30] = 0.0
    items[30:40] = -items[40]
    items[40:60] *= 1e-3
    lengths = np.linalg.norm(items, axis=1)
    table = pa.table(
        {
            "id": np.arange(len(items)),
            "norm": lengths,
            "cell": np.zeros(len(items), np.int32),
            "band": np.zeros(len(items), np.int32),
            "angle": np.zeros(len(items)),
            "features": pa.array(list(items)),
        }
    )
    vectors, ids, bounds, known = factors._pieces(table)
    assert sorted(ids) == list(range(len(items))) and (vectors == items[ids]).all()
    assert (bounds[1:, 0] == bounds[:-1, 1]).all() and (np.diff(bounds) > 0).all() and bounds[-1, 1] == len(items)
    users = np.concatenate([random.normal(size=(60, 8)) + 0.5, -items[50:52], np.zeros((1, 8)), 1e20 * items[70:71]])
    ceilings = factors._piece_ceilings(users, known)
    products = vectors @ users.T
    assert (ceilings >= np.maximum.reduceat(products, bounds[:, 0])).all()
    tenth = -np.partition(-products, 9, axis=0)[9]
    tried = ((ceilings >= tenth) * np.diff(bounds)).sum(axis=0)[:60] / len(items)
    assert tried.mean() < 0.15


def test_long_and_short_vectors_are_ranked_alike(spark):
    """A bar that is tried in short numbers together with the product leaves no item out."""
    random = np.random.default_rng(3)
    users = random.normal(size=(30, 5)) * 10.0 ** random.integers(-6, 7, (30, 1))
    items = random.normal(size=(700, 5)) * 10.0 ** random.integers(-3, 4, (700, 1))
    expected = brute_force(users.astype(np.float32), items.astype(np.float32), 7)
    for limit in (1 << 30, 1):
        found = top_k_items(factor_frame(spark, users), factor_frame(spark, items), 7, limit, 150)
        got = rows(found, "user_id", "movie_id", "score", "rank")
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in expected]
