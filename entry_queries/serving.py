"""The three lookups for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.plans.serving import recommend_by_title, recommend_for_user, search_catalogue
from entry_queries import views
from entry_queries.registry import query
from entry_queries.relational import REQUESTED_USERS, requested_users
from entry_queries.text import (
    CATALOGUE_REQUESTS,
    TITLE_REQUESTS,
    catalogue_requests,
    ranking_views,
    title_requests,
)
from entry_queries.views import with_views


def _by_title(body: str) -> str:
    return with_views(
        "movies_d listed_d",
        body,
        requests=TITLE_REQUESTS,
        **ranking_views("movies_d", "movie_id", ["title"], "SELECT title AS query FROM requests"),
        best="SELECT query AS title, doc_id AS movie_id FROM ranked_hits WHERE rank = 1",
        listing="SELECT * FROM (SELECT movie_id, user_id, row_number() OVER (PARTITION BY movie_id"
        " ORDER BY user_id) AS user_rank FROM listed_d) WHERE user_rank <= 10",
        lists="SELECT user_id, string_agg(CAST(movie_id AS VARCHAR), ',' ORDER BY rank) AS films"
        " FROM listed_d GROUP BY user_id",
        answers="SELECT movie_id, string_agg(concat(user_id, ':', films), ';' ORDER BY user_rank)"
        " AS answer FROM listing JOIN lists USING (user_id) GROUP BY movie_id",
    )


_STATUS = (
    "CASE WHEN title IS NULL OR title = '' THEN 400 WHEN answer IS NULL THEN 404 ELSE 200 END"
)


def _title_lookup(spark, d):
    lists, by_film = views.published(spark, d)
    return recommend_by_title(
        title_requests(spark, d), views.movies(spark, d), lists, by_film=by_film
    )


def _answer(lookup):
    users = F.transform(
        "recommendations",
        lambda u: F.concat_ws(
            ":",
            u["user_id"].cast("string"),
            F.array_join(u["recommendations"]["movie_id"].cast("array<string>"), ","),
        ),
    )
    return lookup.withColumn("answer", F.array_join(users, ";")).drop("recommendations")


@query(
    "recommend_by_title",
    _by_title(
        f"SELECT request_id, title, {_STATUS} AS status,"
        " CASE WHEN title = '' THEN 'title is required'"
        " WHEN movie_id IS NULL THEN 'no film has this title'"
        " WHEN answer IS NULL THEN 'no user is recommended this film' END AS error,"
        " CASE WHEN answer IS NOT NULL THEN CAST(movie_id AS INT) END AS movie_id, answer"
        " FROM requests LEFT JOIN best USING (title) LEFT JOIN answers USING (movie_id)"
    ),
)
def recommend_by_title_query(spark, d):
    return _answer(_title_lookup(spark, d))


@query(
    "join_two_hop",
    _by_title(
        "SELECT request_id, CAST(movie_id AS INT) AS movie_id, answer FROM requests"
        " JOIN best USING (title) JOIN answers USING (movie_id)"
    ),
)
def join_two_hop(spark, d):
    looked_up = _title_lookup(spark, d)
    found = looked_up.filter(F.col("status") == 200)
    return _answer(found).select("request_id", "movie_id", "answer")


@query(
    "no_match_status",
    _by_title(
        f"SELECT status, count(*) AS n_requests FROM (SELECT {_STATUS} AS status FROM requests"
        " LEFT JOIN best USING (title) LEFT JOIN answers USING (movie_id)) GROUP BY status"
    ),
)
def no_match_status(spark, d):
    looked_up = _title_lookup(spark, d)
    return looked_up.groupBy("status").agg(F.count("*").alias("n_requests"))


@query(
    "recommend_for_user",
    with_views(
        "ratings_d listed_d movies_d",
        "SELECT row_id AS request_id, user_id, CASE WHEN user_id NOT IN (SELECT user_id FROM"
        " ratings_d) THEN 404 WHEN films IS NULL THEN 500 ELSE 200 END AS status,"
        " CASE WHEN user_id IN (SELECT user_id FROM ratings_d) THEN films END AS films"
        " FROM requests LEFT JOIN answers USING (user_id)",
        requests="SELECT concat('user-', user_id) AS row_id, user_id FROM ("
        + REQUESTED_USERS
        + ")",
        answers="SELECT user_id, string_agg(concat(movie_id, ':', coalesce(title, 'Unknown')), ','"
        " ORDER BY rank) AS films FROM listed_d LEFT JOIN movies_d USING (movie_id)"
        " GROUP BY user_id",
    ),
)
def recommend_for_user_query(spark, d):
    requests = requested_users(spark, d).withColumn(
        "request_id", F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    )
    looked_up = recommend_for_user(
        requests, views.ratings(spark, d), views.published(spark, d)[0], views.movies(spark, d)
    )
    films = F.transform(
        "recommendations",
        lambda e: F.concat_ws(":", e["movie_id"].cast("string"), e["title"]),
    )
    return looked_up.withColumn("films", F.array_join(films, ",")).drop("recommendations")


# Films without a release date stand for requests without a query.
SEARCH_REQUESTS = (
    CATALOGUE_REQUESTS
    + " UNION ALL SELECT -movie_id, release_date FROM movies_d WHERE release_date = ''"
)


def search_requests(spark, d):
    blank = views.movies(spark, d).filter("release_date = ''")
    return catalogue_requests(spark, d).unionByName(
        blank.select((-F.col("movie_id")).alias("request_id"), F.col("release_date").alias("query"))
    )


@query(
    "search_catalogue",
    with_views(
        "catalogue_d movies_d",
        "SELECT request_id, query, movie_id, title, genres, round(avg_rating, 9) AS avg_rating,"
        " score, rank, 200 AS status FROM requests JOIN ranked_hits USING (query)"
        " JOIN catalogue_d ON movie_id = doc_id"
        " UNION ALL SELECT request_id, query, NULL, NULL, NULL, NULL, NULL, NULL, 400"
        " FROM requests WHERE query IS NULL OR query = ''",
        requests=SEARCH_REQUESTS,
        **ranking_views(
            "catalogue_d", "movie_id", ["title", "genres"], "SELECT query FROM requests"
        ),
    ),
)
def search_catalogue_query(spark, d):
    hits = search_catalogue(search_requests(spark, d), views.catalogue(spark, d))
    return hits.withColumn("avg_rating", F.round("avg_rating", 9))
