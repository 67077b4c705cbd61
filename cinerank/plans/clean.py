"""From the three input files to the cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.functions.catalogue import genre_array, genre_text, parse_release_date
from cinerank.operators.catalogue import with_average_rating
from cinerank.sinks.tables import conform, write_csv, write_table
from cinerank.sources import read_movies, read_ratings, read_users, require_inputs
from cinerank.sources.schemas import CATALOGUE, GENRE_COLUMNS


def clean_catalogue(
    movies: DataFrame, ratings: DataFrame, genre_columns: Sequence[str] = GENRE_COLUMNS
) -> DataFrame:
    """Movies plus ``genres`` (text), ``genres_arr``, a real date and ``avg_rating``.

    One row per film; genres follow the order of ``genre_columns``.
    """
    described = movies.withColumns(
        {
            "genres": genre_text(genre_columns),
            "genres_arr": genre_array(genre_columns),
            "release_date": parse_release_date(F.col("release_date")),
        }
    )
    return with_average_rating(described, ratings)


def catalogue_table(cleaned: DataFrame) -> DataFrame:
    """The searchable columns in their declared types."""
    return conform(cleaned, CATALOGUE)


def clean_files(
    spark: SparkSession, movies_path: str, ratings_path: str, users_path: str, output: str
) -> None:
    """Read, clean and store all three tables, as CSV and as Parquet."""
    require_inputs(spark, [movies_path, ratings_path, users_path])
    ratings = read_ratings(spark, ratings_path)
    tables = {
        "movies_cleaned": clean_catalogue(read_movies(spark, movies_path), ratings),
        "users_cleaned": read_users(spark, users_path),
        "ratings_cleaned": ratings,
    }
    for name, table in tables.items():
        write_table(table, f"{output}/{name}.parquet")
        stored = spark.read.schema(table.schema).parquet(f"{output}/{name}.parquet")
        write_csv(stored.drop("genres_arr"), f"{output}/{name}.csv")
