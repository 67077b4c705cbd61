import threading

from pyspark.sql import functions as F

from cinerank.operators import als
from entry_queries import model as model_queries
from tests.conftest import rows


def test_steps_of_training_leave_the_disk(spark, monkeypatch):
    """Spark ML drops shuffle files when it checkpoints: by default only after all iterations."""
    given = {}
    plain = als.ALS

    def kept(**settings):
        given.update(settings)
        return plain(**settings)

    monkeypatch.setattr(als, "ALS", kept)
    ratings = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 1, 5)], "user_id int, movie_id int, rating int")
    assert als.fit(ratings, max_iter=2).userFactors.count() == 2
    assert given["checkpointInterval"] <= 2


def test_messages_of_one_iteration_stay_and_blocks_are_few(spark, monkeypatch):
    """A factor is sent once for each block: 200 million pairs are not cut to forty of them."""
    given = {}
    plain = als.ALS

    def kept(**settings):
        given.update(settings)
        return plain(**settings)

    dropped = []
    monkeypatch.setattr(als, "ALS", kept)
    monkeypatch.setattr(als, "drop_shuffle_files", dropped.append)
    monkeypatch.setattr(als, "MIN_BLOCKS", 1)
    ratings = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 1, 5)], "user_id int, movie_id int, rating int")
    als.fit(ratings, max_iter=2)
    assert given["checkpointInterval"] == 1 and dropped
    assert given["numUserBlocks"] == given["numItemBlocks"] == 1
    assert -(-200_000_000 // als.PAIRS_PER_BLOCK) < 20


def test_folds_are_trained_one_after_the_other(spark, monkeypatch):
    """The disk holds the shuffle files of one training: the last fold's are dropped before the next."""
    steps = []
    plain_fit, plain_score = als.fit, als.rmse

    def fitted(*args, **params):
        steps.append("fit")
        assert threading.current_thread() is threading.main_thread()
        return plain_fit(*args, **params)

    def scored(predictions):
        steps.append(sorted(predictions.columns))
        return plain_score(predictions)

    monkeypatch.setattr(als, "fit", fitted)
    monkeypatch.setattr(als, "rmse", scored)
    monkeypatch.setattr(als, "drop_shuffle_files", lambda _: steps.append("drop"))
    data = [(u, m, (u * m) % 5 + 1, u, 1 + (u + m) % 2) for u in range(12) for m in range(9)]
    folds = spark.createDataFrame(data, "user_id int, movie_id int, rating int, timestamp int, fold int")
    found = als.cross_validate(folds, 2, seed=1, blocks=2, max_iter=1)
    read = ["movie_id", "prediction", "rating", "user_id"]
    assert [s for s in steps if s != "drop"] == ["fit", read, "fit", read]
    assert steps[steps.index(read) + 1] == "drop" and steps[-1] == "drop"
    assert rows(found, "fold", "n_pairs") == [(1, 54), (2, 54)]


def test_rows_known_in_the_base_are_found_by_the_keys_that_are_not(spark, monkeypatch):
    data = [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 3, 1), (3, 2, 1), (3, 1, 1), (None, 1, 1), (1, None, 2)]
    folds = spark.createDataFrame(data, "user_id int, movie_id int, fold int")
    sizes = []
    plain = model_queries.lookup_join

    def kept(left, right, *args, **kwargs):
        sizes.append(right.count())
        return plain(left, right, *args, **kwargs)

    monkeypatch.setattr(model_queries, "lookup_join", kept)
    # User 3 has rows in fold 1 only and film 3 has one row.
    found = rows(model_queries._known_in_base(folds).filter(F.col("user_id").isNotNull()))
    assert found == [(1, 1, 1), (1, 2, 2), (2, 1, 2)]
    assert sizes[0] <= 2 and sizes[1] <= 2


def test_lists_are_stored_once_before_they_are_published(spark, monkeypatch, tmp_path):
    from cinerank.plans import training

    monkeypatch.setattr(training, "materialise", None)
    data = [(u, m, float(1 + (u * m) % 5)) for u in range(6) for m in range(12)]
    ratings = spark.createDataFrame(data, "user_id int, movie_id int, rating double")
    als.save(als.fit(ratings, seed=1, rank=3, max_iter=1), str(tmp_path / "model"))
    lists = training.publish_pipeline(spark, str(tmp_path / "model"), str(tmp_path / "table"))
    assert lists.count() == 6
    assert spark.read.parquet(str(tmp_path / "table" / "by_film")).count() == 60
