import re

import pytest
from pyspark.sql import functions as F

from cinerank.operators import als
from cinerank.operators import search as search_module
from cinerank.operators.lists import (
    FILM_PART,
    FILM_PARTS,
    film_part,
    first_users_by_film,
    first_users_listed,
    users_by_film,
    users_recommended,
)
from cinerank.plans import serving as serving_module
from cinerank.plans.serving import recommend_by_title, recommend_for_user, search_catalogue
from cinerank.session import scratch_path
from cinerank.sinks.tables import publish_by_film
from cinerank.sources import schemas
from tests.conftest import rows


@pytest.fixture(scope="module")
def films(spark):
    return spark.createDataFrame(
        [
            (1, "Paper Story", "Animation,Comedy", None, 3.5),
            (2, "Story by Us", "Drama", None, None),
            (3, "Heat", "Action,Drama", None, 4.0),
        ],
        schemas.CATALOGUE,
    )


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(
        [(10, [(1, 4.5), (3, 4.0)]), (20, [(3, 5.0), (77, 2.0)]), (30, [(1, 1.0)])],
        schemas.RECOMMENDATIONS,
    )


def by_title(spark, films, lists, titles, k=10):
    requests = spark.createDataFrame(list(enumerate(titles)), "request_id int, title string")
    found = recommend_by_title(requests, films, lists, k).collect()
    return {row["request_id"]: row for row in found}


def test_title_statuses(spark, films, lists):
    got = by_title(spark, films, lists, ["Paper Story", "", None, "Unheard Of", "us", "Paper Story"])
    assert [got[i]["status"] for i in range(6)] == [200, 400, 400, 404, 404, 200]
    assert got[0]["movie_id"] == 1 and got[0]["error"] is None
    assert [u["user_id"] for u in got[0]["recommendations"]] == [10, 30]
    assert [e["movie_id"] for e in got[0]["recommendations"][0]["recommendations"]] == [1, 3]
    assert got[1]["error"] == got[2]["error"] == "title is required"
    assert got[3]["error"] != got[4]["error"]  # no such film / nobody is recommended it
    assert got[3]["recommendations"] is None and got[4]["recommendations"] is None


def test_title_lookup_reads_the_table_by_film(spark, films, lists):
    path = scratch_path(spark, "by-film")
    publish_by_film(lists, path)
    requests = spark.createDataFrame(
        list(enumerate(["Paper Story", "", None, "Unheard Of", "us"])), "request_id int, title string"
    )
    by_film = spark.read.parquet(path)
    served = recommend_by_title(requests, films, lists, by_film=by_film)
    assert rows(served) == rows(recommend_by_title(requests, films, lists))
    none = recommend_by_title(requests.filter("request_id > 0"), films, lists, by_film=by_film)
    assert none.count() == 4


def test_lookup_by_film_in_an_empty_table(spark):
    path = scratch_path(spark, "by-film")
    publish_by_film(spark.createDataFrame([], schemas.RECOMMENDATIONS), path)
    by_film = spark.read.schema(
        f"movie_id int, user_id int, {FILM_PARTS} int, {FILM_PART} int"
    ).parquet(path)
    wanted = spark.createDataFrame([(1,)], "movie_id int")
    assert first_users_listed(by_film, wanted, 3).count() == 0


def test_lookup_by_film_reads_only_folders_of_wanted_films(spark, capsys):
    table = spark.range(400).selectExpr(
        "cast(id AS int) AS user_id",
        "transform(sequence(1, 200), m -> struct(cast(m AS int) AS movie_id, 1f AS rating))"
        " AS recommendations",
    )
    path = scratch_path(spark, "by-film")
    publish_by_film(table, path, folder_rows=2000)
    by_film = spark.read.parquet(path)
    assert by_film.count() == 400 * 200
    wanted = spark.createDataFrame([(17,), (180,), (17,), (999,)], "movie_id int")
    number = by_film.select(FILM_PARTS).first()[0]
    parts = {r[0] for r in wanted.select(film_part(number)).collect()}
    assert len(parts) <= 3 and number == 41
    found = first_users_listed(by_film, wanted, 3)
    want = [(m, u, u + 1) for m in (17, 180) for u in range(3)]
    assert rows(found, "movie_id", "user_id", "user_rank") == want
    found.explain("formatted")
    filters = re.findall(r"PartitionFilters: \[(.*)\]", capsys.readouterr().out)
    named = re.findall(rf"{FILM_PART}#\d+ (?:IN \(([\d,]+)\)|= (\d+))", " ".join(filters))
    assert {int(n) for pair in named for n in "".join(pair).split(",")} == parts


def test_a_film_in_every_list_fills_many_files(spark):
    """One film holds a half of all entries; its folder is written by several tasks."""
    table = spark.range(4000).selectExpr(
        "cast(id AS int) AS user_id",
        "array(struct(cast(7 AS int) AS movie_id, 1f AS rating),"
        " struct(cast(id % 50 + 100 AS int) AS movie_id, 1f AS rating)) AS recommendations",
    )
    path = scratch_path(spark, "by-film")
    # So small a table would be written by one task.
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        publish_by_film(table, path)
    finally:
        spark.conf.unset(merging)
    hot = spark.read.parquet(path).filter("movie_id = 7")
    assert hot.count() == 4000
    assert hot.select(F.input_file_name()).distinct().count() > 1


def test_title_users_are_a_page(spark, films, lists):
    got = by_title(spark, films, lists, ["heat"], k=1)
    assert [u["user_id"] for u in got[0]["recommendations"]] == [10]


def test_user_lookup(spark, films, lists):
    ratings = spark.createDataFrame([(10, 1, 3, 0), (20, 3, 3, 0), (40, 1, 5, 0)], schemas.RATINGS)
    requests = spark.createDataFrame(
        [(0, 10), (1, 20), (2, 99), (3, 40), (4, 10)], "request_id int, user_id int"
    )
    got = {r["request_id"]: r for r in recommend_for_user(requests, ratings, lists, films).collect()}
    assert [got[i]["status"] for i in range(5)] == [200, 200, 404, 500, 200]
    assert [e["title"] for e in got[0]["recommendations"]] == ["Paper Story", "Heat"]
    assert [tuple(e) for e in got[1]["recommendations"]] == [(3, "Heat", 5.0), (77, "Unknown", 2.0)]
    assert got[2]["recommendations"] is None and got[0]["recommendations"] == got[4]["recommendations"]


def test_search_covers_genres_and_may_be_empty(spark, films):
    requests = spark.createDataFrame(
        [(0, "drama"), (1, "story"), (2, "zzz"), (3, "")], "request_id int, query string"
    )
    found = search_catalogue(requests, films)
    got = rows(found.filter("status = 200"), "request_id", "rank", "movie_id", "avg_rating")
    assert got == [(0, 1, 2, None), (0, 2, 3, 4.0), (1, 1, 1, 3.5), (1, 2, 2, None)]
    # A missing query is refused; one without hits is not.
    refused = found.filter("status = 400")
    assert rows(refused, "request_id", "query", "movie_id") == [(3, "", None)]


def test_list_lookups(spark, lists):
    assert rows(users_recommended(lists, 3), "user_id") == [(10,), (20,)]
    wanted = spark.createDataFrame([(1,), (3,), (3,), (500,)], "movie_id int")
    assert rows(users_by_film(lists, wanted), "movie_id", "user_id") == [(1, 10), (1, 30), (3, 10), (3, 20)]
    assert rows(first_users_by_film(lists, wanted, 1), "movie_id", "user_id") == [(1, 10), (3, 10)]


@pytest.fixture(scope="module")
def model(spark):
    data = [(u, m, (u * m) % 5 + 1, 0) for u in range(1, 25) for m in range(1, 20) if (u + m) % 3]
    ratings = spark.createDataFrame(data + data[:40], schemas.RATINGS)
    return als.fit(ratings, seed=3, blocks=2), ratings


def test_lists_equal_the_librarys_own(model):
    fitted, _ = model
    library = {
        row["user_id"]: row["recommendations"] for row in fitted.recommendForAllUsers(10).collect()
    }
    ours = {row["user_id"]: row["recommendations"] for row in als.recommendations(fitted).collect()}
    assert sorted(ours) == sorted(library)
    for user, entries in ours.items():
        theirs = {e["movie_id"]: e["rating"] for e in library[user]}
        assert [e["rating"] for e in entries] == pytest.approx(sorted(theirs.values())[::-1], abs=1e-4)
        assert len(set(theirs) & {e["movie_id"] for e in entries}) >= 9


def test_predictions_equal_the_librarys_own(model):
    fitted, ratings = model
    pairs = ratings.select("user_id", "movie_id").distinct()
    ours = rows(als.predict(fitted, pairs), "user_id", "movie_id", "prediction")
    library = rows(fitted.transform(pairs), "user_id", "movie_id", "prediction")
    assert [r[:2] for r in ours] == [r[:2] for r in library]
    assert [r[2] for r in ours] == pytest.approx([r[2] for r in library], abs=1e-4)


def test_rmse_equals_the_evaluators(model):
    from pyspark.ml.evaluation import RegressionEvaluator

    from cinerank.operators.evaluate import rmse

    fitted, ratings = model
    predicted = als.predict(fitted, ratings)
    evaluator = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    assert rmse(predicted).first()["rmse"] == pytest.approx(evaluator.evaluate(predicted))


def test_unknown_user_gets_no_row(spark, model):
    asked = spark.createDataFrame([(1,), (1,), (999,)], "user_id int")
    got = rows(als.recommend_subset(model[0], asked), "user_id", "rank")
    assert got == sorted(((1, rank) for rank in range(1, 11)), key=repr)


def test_training_reports_and_publishes(spark, model, tmp_path):
    from cinerank.plans.training import publish_pipeline, train

    path = str(tmp_path / "model")
    row = train(model[1], path, "run-1", seed=5, blocks=2).first()
    assert row["run_id"] == "run-1" and row["rank"] == 10 and row["rmse"] > 0
    table = publish_pipeline(spark, path, str(tmp_path / "table"))
    assert table.schema == schemas.RECOMMENDATIONS
    by_film = spark.read.parquet(str(tmp_path / "table" / "by_film"))
    assert by_film.count() == 10 * table.count()


def test_cross_validation_covers_every_pair(model):
    from cinerank.operators.splits import assign_folds

    pairs = model[1].dropDuplicates(["user_id", "movie_id"])
    # Mixed order, so that no fold takes all rows of a user or film.
    pairs = pairs.selectExpr("*", "(user_id * 31 + movie_id * 17) % 23 AS mix")
    folds = assign_folds(pairs, 2, ["mix", "user_id", "movie_id"])
    scores = als.cross_validate(folds, 2, seed=1, blocks=2, max_iter=2)
    assert [row[0] for row in rows(scores, "fold")] == [1, 2]
    mean = als.mean_rmse(scores).first()
    assert mean["n_folds"] == 2 and mean["mean_rmse"] > 0


def test_a_saved_model_replaces_what_was_there_and_loads_equal(spark):
    data = [(u, m, float(1 + (u * m) % 5)) for u in range(30) for m in range(20) if (u + m) % 3]
    ratings = spark.createDataFrame(data, "user_id int, movie_id int, rating double")
    path = scratch_path(spark, "model")
    als.save(als.fit(ratings, seed=1, rank=3, max_iter=2), path)
    model = als.fit(ratings, seed=2, rank=4, max_iter=2)
    als.save(model, path)
    stored = als.load(path)
    assert stored.rank == 4
    pairs = ratings.select("user_id", "movie_id")
    assert rows(als.predict(stored, pairs)) == rows(als.predict(model, pairs))


def test_details_are_looked_up_for_texts_and_not_for_requests(spark, films, monkeypatch):
    sizes = {}
    plain = search_module.materialise_measured

    def kept(df, label):
        stored = plain(df, label)
        sizes[label] = stored[0].count()
        return stored

    monkeypatch.setattr(search_module, "materialise_measured", kept)
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.lit("star").alias("query"))
    catalogue = spark.createDataFrame(
        [(1, "star one", "war", 3.5), (2, "star", "war", None), (3, "other", "sky", 4.0)],
        "movie_id int, title string, genres string, avg_rating double",
    )
    found = search_catalogue(requests, catalogue)
    assert found.count() == 1000 and sizes["hits"] == 2
    first = found.filter("request_id = 7 AND rank = 1")
    assert rows(first, "movie_id", "title", "genres", "avg_rating", "status") == [(2, "star", "war", None, 200)]


def test_requests_meet_few_titles_where_they_are(spark, films, lists, capsys):
    """Answers are measured and broadcast, so equal titles of many requests go to no one task."""
    requests = spark.createDataFrame([(i, "Paper Story") for i in range(50)], "request_id int, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = recommend_by_title(requests, films, lists)
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert found.filter("status = 200 and size(recommendations) = 2").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_titles_that_no_film_can_have_are_left_out_first(spark, films, lists, monkeypatch):
    """Only titles with a term of the index are made distinct and searched for."""
    titles = ["Paper Story", "us", "Paper Story", "", None, *[f"Customer#{i:09d}" for i in range(50)]]
    stored, plain = {}, serving_module.materialise

    def kept(df, label):
        stored[label] = plain(df, label)
        return stored[label]

    monkeypatch.setattr(serving_module, "materialise", kept)
    got = by_title(spark, films, lists, titles)
    assert sorted(row["title"] for row in stored["titles"].collect()) == ["Paper Story", "us"]
    assert [got[i]["status"] for i in range(6)] == [200, 404, 200, 400, 400, 404] and len(got) == 55
    # Beyond the broadcast all titles are kept, and the answers are the same.
    monkeypatch.setattr(search_module, "BROADCAST_LIMIT", 0)
    assert by_title(spark, films, lists, titles) == got
    assert stored["titles"].count() == 52
