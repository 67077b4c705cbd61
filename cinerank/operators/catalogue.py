"""Joins and aggregates of the catalogue clean-up, and request presence tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.functions.catalogue import default_title
from cinerank.operators.skew import lookup_join


def average_rating(ratings: DataFrame) -> DataFrame:
    """Mean rating per film; partial sums are formed before the shuffle."""
    return ratings.groupBy("movie_id").agg(F.avg("rating").alias("avg_rating"))


def pair_average(ratings: DataFrame) -> DataFrame:
    """One rating per (user, film): repeated pairs are averaged."""
    return ratings.groupBy("user_id", "movie_id").agg(F.avg("rating").alias("rating"))


def with_average_rating(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every film, with its mean rating or NULL.  Both sides have one row per film."""
    return movies.join(average_rating(ratings), "movie_id", "left")


def with_titles(recommended: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``title`` by ``movie_id``; films the catalogue lacks become 'Unknown'."""
    titles = catalogue.select("movie_id", "title")
    joined = lookup_join(recommended, titles, "movie_id", "left")
    return joined.withColumn("title", default_title(F.col("title")))


def user_activity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count("*").alias("n_ratings"))


def active_users(ratings: DataFrame, at_least: int) -> DataFrame:
    """Ratings of users with at least ``at_least`` of them."""
    users = user_activity(ratings).filter(F.col("n_ratings") >= at_least).select("user_id")
    return lookup_join(ratings, users, "user_id", "left_semi", computed=True)


def rated_users(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """The users of ``requests`` who have rated something, each once.

    Ratings of other users are left out before anything is made distinct.
    """
    asked = requests.select("user_id").distinct()
    return lookup_join(
        ratings.select("user_id"), asked, "user_id", "left_semi", computed=True
    ).distinct()


def with_known(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """``requests`` with ``known``: whether the user has rated something."""
    rated = rated_users(requests, ratings).withColumn("known", F.lit(True))
    joined = lookup_join(requests, rated, "user_id", "left", computed=True)
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def known_users(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Requests whose user has rated something."""
    return lookup_join(
        requests, rated_users(requests, ratings), "user_id", "left_semi", computed=True
    )


def unknown_users(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    return lookup_join(
        requests, rated_users(requests, ratings), "user_id", "left_anti", computed=True
    )


def parameter_missing(parameter: Column) -> Column:
    """True for NULL and for the empty string."""
    return parameter.isNull() | (parameter == "")


def dataset_profile(ratings: DataFrame) -> DataFrame:
    """Numbers of users, films and ratings, in one row."""
    return ratings.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("movie_id").alias("n_movies"),
        F.count("*").alias("n_ratings"),
    )
