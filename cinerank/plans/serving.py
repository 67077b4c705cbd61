"""The three lookups, each for a whole table of requests.

``status`` holds what a single request would have been answered with: 200,
400 for a missing parameter, 404 when nothing was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.operators.catalogue import parameter_missing, with_titles
from cinerank.operators.lists import first_users_by_film, first_users_listed
from cinerank.operators.search import PAGE, TextIndex, build_index, first_hit, known_texts, search
from cinerank.operators.skew import lookup_join, materialise_measured, sized_join
from cinerank.operators.topk import as_ranked_list, explode_list
from cinerank.session import materialise


def _nested(ranked: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """At most ``k`` ranked rows per group as ``recommendations``."""
    return as_ranked_list(ranked, group, fields, "recommendations")


def _text_lookup(requests: DataFrame, text: str) -> DataFrame:
    """Requests whose text is present; only these are searched."""
    return requests.filter(~parameter_missing(F.col(text)))


def best_films(
    requests: DataFrame, catalogue: DataFrame, index: TextIndex | None = None
) -> DataFrame:
    """(title, movie_id): the best film for each distinct requested title."""
    index = index or build_index(catalogue, "movie_id", ["title"])
    # Read several times; requests may be many and hold few titles that can be found.
    titles = materialise(known_texts(_text_lookup(requests, "title"), "title", index), "titles")
    return first_hit(titles.withColumn("_text", F.col("title")), "_text", "title", index).select(
        F.col("query").alias("title"), F.col("doc_id").cast("int").alias("movie_id")
    )


def recommend_by_title(
    requests: DataFrame,
    catalogue: DataFrame,
    recommendations: DataFrame,
    k: int = PAGE,
    index: TextIndex | None = None,
    by_film: DataFrame | None = None,
) -> DataFrame:
    """request_id, title -> plus status, error, movie_id, recommendations.

    The film is the best title match; ``recommendations`` holds up to ``k``
    users (lowest ids) whose published list contains it, each with that list.
    ``by_film`` is the published table by film; with it, lists are read by user only.
    """
    films = materialise(best_films(requests, catalogue, index), "best-films")
    if by_film is None:
        listed = first_users_by_film(recommendations, films, k)
    else:
        listed = first_users_listed(by_film, films, k)
    users, size = materialise_measured(listed, "film-users")
    wanted = users.select("user_id").distinct()
    lists = sized_join(
        recommendations.select("user_id", "recommendations"), wanted, "user_id", size, "left_semi"
    )
    answers = _nested(
        users.join(lists, "user_id").withColumnRenamed("user_rank", "rank"),
        "movie_id",
        ["user_id", "recommendations"],
    )
    by_title = films.join(answers, "movie_id", "left")
    missing = parameter_missing(F.col("title"))
    # Requests without a title are answered where they are, and the others too where titles are few.
    joined = lookup_join(
        requests.filter(~missing), by_title, "title", "left", computed=True
    ).unionByName(requests.filter(missing), allowMissingColumns=True)
    error = (
        F.when(missing, "title is required")
        .when(F.col("movie_id").isNull(), "no film has this title")
        .when(F.col("recommendations").isNull(), "no user is recommended this film")
    )
    status = (
        F.when(missing, 400)
        .when(F.col("movie_id").isNull() | F.col("recommendations").isNull(), 404)
        .otherwise(200)
    )
    return joined.select(
        "request_id",
        "title",
        status.alias("status"),
        error.alias("error"),
        F.when(status == 200, F.col("movie_id")).alias("movie_id"),
        "recommendations",
    )


def recommend_for_user(
    requests: DataFrame, ratings: DataFrame, recommendations: DataFrame, catalogue: DataFrame
) -> DataFrame:
    """request_id, user_id -> plus status, recommendations with titles.

    404 when the user has no rating.  A user who has ratings but is unknown to
    the model gets 500: there is a user and no list to answer with.
    """
    users, size = materialise_measured(requests.select("user_id").distinct(), "request-users")
    rated = sized_join(ratings.select("user_id"), users, "user_id", size, "left_semi").distinct()
    lists = sized_join(recommendations, users, "user_id", size, "left_semi")
    titled = with_titles(explode_list(lists), catalogue)
    answers = _nested(
        titled.withColumnRenamed("rating", "predicted_rating"),
        "user_id",
        ["movie_id", "title", "predicted_rating"],
    )
    found = requests.join(rated.withColumn("_rated", F.lit(True)), "user_id", "left")
    joined = found.join(answers, "user_id", "left")
    status = (
        F.when(F.col("_rated").isNull(), 404)
        .when(F.col("recommendations").isNull(), 500)
        .otherwise(200)
    )
    return joined.select(
        "request_id",
        "user_id",
        status.alias("status"),
        F.when(status == 200, F.col("recommendations")).alias("recommendations"),
    )


def search_catalogue(
    requests: DataFrame, catalogue: DataFrame, k: int = PAGE, index: TextIndex | None = None
) -> DataFrame:
    """request_id, query -> status and hits: movie_id, title, genres, avg_rating, score, rank.

    Title and genres are searched, the better field counts.  A query without a
    match has no rows; unlike the title lookup that is not an error.  A request
    without a query has one row with status 400 and no hit.
    """
    index = index or build_index(catalogue, "movie_id", ["title", "genres"])
    details = catalogue.select(F.col("movie_id").alias("doc_id"), "title", "genres", "avg_rating")
    hits = search(_text_lookup(requests, "query"), "request_id", "query", index, k, details)
    found = hits.select(
        F.col("doc_id").alias("movie_id"), "request_id", "query", "score", "rank", "title", "genres", "avg_rating"
    )
    refused = requests.filter(parameter_missing(F.col("query"))).select("request_id", "query")
    return found.withColumn("status", F.lit(200)).unionByName(
        refused.withColumn("status", F.lit(400)), allowMissingColumns=True
    )
