"""Declared schemas of the input files and of the tables built from them."""

from __future__ import annotations

from pyspark.sql import types as T

# The genre flags of the item file, in file order.
FLAG_COLUMNS = [
    "unknown", "Action", "Adventure", "Animation", "Children's", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery",
    "Romance", "Sci-Fi", "Thriller", "War", "Western",
]
# The `unknown` flag is read but never becomes a genre.
GENRE_COLUMNS = FLAG_COLUMNS[1:]

MOVIES = T.StructType(
    [
        T.StructField("movie_id", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("video_release_date", T.StringType()),
        T.StructField("IMDb_URL", T.StringType()),
    ]
    + [T.StructField(name, T.IntegerType()) for name in FLAG_COLUMNS]
)

RATINGS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("movie_id", T.IntegerType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

# zip_code stays text: some codes are alphanumeric and some start with a zero.
USERS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("occupation", T.StringType()),
        T.StructField("zip_code", T.StringType()),
    ]
)

RECOMMENDATIONS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField(
            "recommendations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("movie_id", T.IntegerType()),
                        T.StructField("rating", T.FloatType()),
                    ]
                )
            ),
        ),
    ]
)

CATALOGUE = T.StructType(
    [
        T.StructField("movie_id", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("avg_rating", T.FloatType()),
    ]
)
