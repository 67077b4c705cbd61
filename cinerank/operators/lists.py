"""Lookups in published recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.operators.skew import lookup_join
from cinerank.operators.topk import first_k

# Folder columns of the published table by film: how many parts it has, and which one.
FILM_PARTS, FILM_PART = "film_parts", "film_part"


def film_part(parts: int) -> Column:
    """The part of a film in a published table by film of so many parts."""
    return F.pmod(F.xxhash64(F.col("movie_id").cast("long")), F.lit(parts)).cast("int")


def entries(recommendations: DataFrame) -> DataFrame:
    """One row per list entry: user_id, movie_id, rating."""
    return recommendations.select("user_id", F.inline("recommendations"))


def users_recommended(recommendations: DataFrame, movie_id: int) -> DataFrame:
    """Users whose list holds one film, with their lists."""
    return recommendations.filter(
        F.exists("recommendations", lambda entry: entry["movie_id"] == movie_id)
    )


def users_by_film(recommendations: DataFrame, films: DataFrame) -> DataFrame:
    """(movie_id, user_id) for every requested film and every user whose list holds it.

    Lists are filtered by film where they are; a list names a film once, so
    each entry yields at most one row however many requests share the film.
    """
    wanted = films.select("movie_id").distinct()
    listed = entries(recommendations).select("movie_id", "user_id")
    return lookup_join(listed, wanted, "movie_id", "left_semi")


def first_users_by_film(recommendations: DataFrame, films: DataFrame, k: int) -> DataFrame:
    """At most ``k`` users per film, lowest ids first, plus ``user_rank``."""
    return first_k(users_by_film(recommendations, films), k, "movie_id", ["user_id"], "user_rank")


def first_users_listed(by_film: DataFrame, films: DataFrame, k: int) -> DataFrame:
    """The same from the published table by film, which lies in folders by ``film_part``.

    Only folders of the wanted films are read, and of these only row groups within the
    range of their ids, which is one film where one is asked for.
    """
    wanted = films.select("movie_id").distinct()
    stored = by_film.select(FILM_PARTS).first()
    # No more numbers than the table has folders.
    low, high, parts = wanted.agg(
        F.min("movie_id"),
        F.max("movie_id"),
        F.collect_set(film_part(stored[FILM_PARTS] if stored else 1)),
    ).first()
    listed = by_film.filter(
        F.col(FILM_PART).isin(parts) & F.col("movie_id").between(low, high)
    ).select("movie_id", "user_id")
    found = lookup_join(listed, wanted, "movie_id", "left_semi")
    return first_k(found, k, "movie_id", ["user_id"], "user_rank")
