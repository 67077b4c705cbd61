import datetime

import pytest
from pyspark.sql import functions as F

from cinerank import sinks, sources
from cinerank.functions import epoch_to_utc, parse_release_date
from cinerank.operators import catalogue as cat
from cinerank.plans.clean import catalogue_table, clean_catalogue, clean_files
from cinerank.session import scratch_path
from cinerank.sources import schemas
from tests.conftest import rows

FLAGS = len(schemas.FLAG_COLUMNS)


def item(movie_id, date, on=(), title=None):
    flags = [1 if name in on else 0 for name in schemas.FLAG_COLUMNS]
    return (movie_id, title or f"Film {movie_id}", date, None, "http://x", *flags)


@pytest.fixture(scope="module")
def cleaned(spark):
    movies = spark.createDataFrame(
        [
            item(1, "01-Jan-1995", {"Animation", "Children's", "Comedy"}),
            item(2, "4-Feb-1971", {"unknown"}),
            item(3, "", ()),
            item(4, None, {"Western", "Film-Noir", "Sci-Fi"}),
            item(5, "not a date", {"Drama"}),
            item(6, "31-Feb-1990", {"War"}),
        ],
        schemas.MOVIES,
    )
    ratings = spark.createDataFrame(
        [(1, 1, 5, 0), (2, 1, 2, 0), (2, 1, 2, 0), (1, 99, 4, 0), (1, 3, 1, 0)], schemas.RATINGS
    )
    return {row["movie_id"]: row for row in clean_catalogue(movies, ratings).collect()}


def test_one_row_per_film(cleaned):
    assert sorted(cleaned) == [1, 2, 3, 4, 5, 6]


def test_genres_follow_the_list_order_and_leave_out_unknown(cleaned):
    assert cleaned[1]["genres"] == "Animation,Children's,Comedy"
    assert cleaned[4]["genres"] == "Film-Noir,Sci-Fi,Western"
    assert cleaned[2]["genres"] == "" and cleaned[3]["genres"] == ""
    assert cleaned[4]["genres_arr"] == ["Film-Noir", "Sci-Fi", "Western"]
    assert cleaned[3]["genres_arr"] == []


def test_dates_with_one_or_two_digits_and_the_rest_null(cleaned):
    assert cleaned[1]["release_date"] == datetime.date(1995, 1, 1)
    assert cleaned[2]["release_date"] == datetime.date(1971, 2, 4)
    assert [cleaned[i]["release_date"] for i in (3, 4, 5, 6)] == [None] * 4


def test_mean_rating_is_null_for_unrated_films(cleaned):
    assert cleaned[1]["avg_rating"] == 3.0
    assert cleaned[3]["avg_rating"] == 1.0
    assert cleaned[2]["avg_rating"] is None


def test_epoch_is_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.range(1).select(epoch_to_utc(F.lit(900000000)).alias("at"))
            assert df.first()["at"] == datetime.datetime(1998, 7, 9, 16, 0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_date_parser_never_raises(spark):
    texts = spark.createDataFrame([("1-Xxx-1990",), ("",), (None,), ("1/2/1990",)], "t string")
    assert rows(texts.select(parse_release_date(F.col("t")))) == [(None,)] * 4


def test_files_are_cleaned_end_to_end(spark, tmp_path):
    """Latin-1 titles, missing fields and zip codes with letters and leading zeros survive."""
    movies = "|".join(["1", "Été (1999)", "4-Feb-1971", "", "http://x"] + ["0", "1"] + ["0"] * (FLAGS - 2))
    blank = "|".join(["2", "Blank", "", "", ""] + ["1"] + ["0"] * (FLAGS - 1))
    (tmp_path / "items").write_text(movies + "\n" + blank + "\n", encoding="iso-8859-1")
    (tmp_path / "ratings").write_text("1\t1\t3\t900000001\n2\t1\t5\t900000002\n")
    (tmp_path / "users").write_text("1|30|M|baker|05711\n2|41|F|painter|K1A0B\n")
    out = str(tmp_path / "out")
    clean_files(spark, *[str(tmp_path / n) for n in ("items", "ratings", "users")], out)
    films = sources.read_table(spark, f"{out}/movies_cleaned.parquet")
    assert rows(films, "movie_id", "title", "genres", "avg_rating") == [
        (1, "Été (1999)", "Action", 4.0),
        (2, "Blank", "", None),
    ]
    users = sources.read_csv_table(spark, f"{out}/users_cleaned.csv", schemas.USERS)
    assert [row[4] for row in rows(users)] == ["05711", "K1A0B"]
    ratings = sources.read_csv_table(spark, f"{out}/ratings_cleaned.csv", schemas.RATINGS)
    assert rows(ratings) == [(1, 1, 3, 900000001), (2, 1, 5, 900000002)]
    assert catalogue_table(films).schema == schemas.CATALOGUE


def test_missing_inputs_are_all_named(spark, tmp_path):
    (tmp_path / "there").write_text("x\n")
    sources.require_inputs(spark, [str(tmp_path / "there")])
    with pytest.raises(FileNotFoundError, match="one.*two"):
        sources.require_inputs(
            spark, [str(tmp_path / n) for n in ("one", "there", "two")]
        )


def test_requests_frame(spark):
    frame = sources.requests_frame(spark, [3, 1], "user_id", schemas.USERS["user_id"].dataType)
    assert rows(frame) == [(1,), (3,)]


def test_ensure_keeps_and_rebuild_replaces(spark):
    path = scratch_path(spark, "table")
    films = spark.createDataFrame([(1, "A", "", None, 2.5)], schemas.CATALOGUE)
    sinks.ensure_table(spark, path, schemas.CATALOGUE)
    assert sources.read_table(spark, path, schemas.CATALOGUE).count() == 0
    films.write.mode("append").parquet(path)
    sinks.ensure_table(spark, path, schemas.CATALOGUE)
    assert sources.read_table(spark, path, schemas.CATALOGUE).count() == 1
    sinks.rebuild_table(films.withColumn("title", F.lit("B")), path, schemas.CATALOGUE)
    assert rows(sources.read_table(spark, path), "title") == [("B",)]


def test_publishing_again_replaces_a_users_list(spark):
    path = scratch_path(spark, "lists")
    first = spark.createDataFrame([(1, [(5, 1.0)]), (2, [(6, 2.0)])], schemas.RECOMMENDATIONS)
    again = spark.createDataFrame([(2, [(7, 3.0)])], schemas.RECOMMENDATIONS)
    sinks.publish(first, path)
    sinks.publish(first, path)
    stored = sources.read_table(spark, path, schemas.RECOMMENDATIONS)
    assert stored.count() == 2
    merged = rows(sinks.upsert(stored, again, "user_id"))
    assert [(user, [tuple(e) for e in films]) for user, films in merged] == [
        (1, [(5, 1.0)]),
        (2, [(7, 3.0)]),
    ]


def test_the_last_write_of_a_key_holds(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame(
        [(1, "x", 1), (1, "y", 2), (3, "p", 5), (3, "q", 4)], "k int, v string, at int"
    )
    assert rows(sinks.upsert(old, batch, "k", "at")) == [(1, "y"), (2, "b"), (3, "p")]


def test_presence_activity_and_profile(spark):
    ratings = spark.createDataFrame([(1, 1, 3, 0), (1, 2, 4, 0), (2, 1, 5, 0)], schemas.RATINGS)
    asked = spark.createDataFrame([(1,), (1,), (3,)], "user_id int")
    assert rows(cat.known_users(asked, ratings)) == [(1,), (1,)]
    assert rows(cat.unknown_users(asked, ratings)) == [(3,)]
    assert {row[0] for row in rows(cat.active_users(ratings, 2), "user_id")} == {1}
    assert rows(cat.dataset_profile(ratings)) == [(2, 2, 3)]
    empty = spark.createDataFrame([(None,), ("",), ("x",)], "p string")
    assert rows(empty.select(cat.parameter_missing(F.col("p")))) == [(False,), (True,), (True,)]
