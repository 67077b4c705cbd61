"""Rating and catalogue tables derived from the given ones, in Spark and in SQL.

Orders stand for users rating films: a line item is a rating of its part by the
order's customer.  Parts are the films, customers the users, and the embedding
table serves as both user and item factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.operators.factors import recommendation_lists, top_k_items
from cinerank.plans.clean import clean_catalogue
from cinerank.session import scratch_path
from cinerank.sinks.tables import publish, publish_by_film
from cinerank.sources import read_table
from cinerank.sources.schemas import FLAG_COLUMNS, GENRE_COLUMNS


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    path = f"{folder}/{name}.parquet"
    found = read_table(spark, path, _schemas.get(path))
    _schemas.setdefault(path, found.schema)
    return found


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, independent of the session zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("movie_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating"),
        epoch_seconds("l_shipdate").alias("timestamp"),
    )


def movies(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    month = F.when(key % 2 == 0, F.lit("-Feb-")).otherwise(F.lit("-Nov-"))
    day = (1 + key % 28).cast("string")
    year = (1950 + key % 49).cast("string")
    release = F.when(key % 50 == 0, F.lit("")).otherwise(F.concat(day, month, year))
    flags = [
        F.when(F.col("p_size") % (i + 2) == 0, 1).otherwise(0).alias(name)
        for i, name in enumerate(FLAG_COLUMNS)
    ]
    return table(spark, folder, "part").select(
        key.cast("int").alias("movie_id"),
        F.col("p_name").alias("title"),
        release.alias("release_date"),
        F.lit(None).cast("string").alias("video_release_date"),
        F.concat(F.lit("http://films/"), key.cast("string")).alias("IMDb_URL"),
        *flags,
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.cast("int").alias("user_id"),
        (18 + key % 56).cast("int").alias("age"),
        F.when(key % 3 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.lower("c_mktsegment").alias("occupation"),
        F.lpad((key % 99999).cast("string"), 5, "0").alias("zip_code"),
    )


def sequence(spark: SparkSession, folder: str) -> DataFrame:
    """User actions with a unique, ordered ``seq``."""
    return table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("seq"), "event_type", "value"
    )


def factors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features")
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_catalogue(movies(spark, folder), ratings(spark, folder))
    return cleaned.select("movie_id", "title", "genres", "release_date", "avg_rating")


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Top ten of every vector against all vectors."""
    vectors = factors(spark, folder)
    return top_k_items(vectors, vectors, 10)


def lists(spark: SparkSession, folder: str) -> DataFrame:
    return recommendation_lists(ranked(spark, folder))


_published: dict[tuple[str, str], str] = {}


def published(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The lists as published: by user and by film, scored and written once a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _published:
        path = scratch_path(spark, "published")
        publish(lists(spark, folder), f"{path}/by_user")
        publish_by_film(spark.read.parquet(f"{path}/by_user"), f"{path}/by_film")
        _published[key] = path
    path = _published[key]
    return spark.read.parquet(f"{path}/by_user"), spark.read.parquet(f"{path}/by_film")


_FLAGS_SQL = ", ".join(
    f"""CASE WHEN p_size % {i + 2} = 0 THEN 1 ELSE 0 END AS "{name}\""""
    for i, name in enumerate(FLAG_COLUMNS)
)
_GENRES_SQL = (
    "concat_ws(',', "
    + ", ".join(
        "CASE WHEN \"{0}\" = 1 THEN '{1}' END".format(name, name.replace("'", "''"))
        for name in GENRE_COLUMNS
    )
    + ")"
)
_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def tokens_sql(column: str) -> str:
    return _TOKENS.format(column)


VIEWS = {
    "ratings_d": (
        [],
        "SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS movie_id,"
        " CAST(floor((l_quantity - 1) / 10) + 1 AS INT) AS rating,"
        ' CAST(floor(epoch(l_shipdate)) AS BIGINT) AS "timestamp"'
        " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "movies_d": (
        [],
        "SELECT CAST(p_partkey AS INT) AS movie_id, p_name AS title,"
        " CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat(CAST(1 + p_partkey % 28 AS VARCHAR),"
        " CASE WHEN p_partkey % 2 = 0 THEN '-Feb-' ELSE '-Nov-' END,"
        " CAST(1950 + p_partkey % 49 AS VARCHAR)) END AS release_date,"
        " CAST(NULL AS VARCHAR) AS video_release_date,"
        ' concat(\'http://films/\', CAST(p_partkey AS VARCHAR)) AS "IMDb_URL",'
        f" {_FLAGS_SQL} FROM part",
    ),
    "users_d": (
        [],
        "SELECT CAST(c_custkey AS INT) AS user_id, CAST(18 + c_custkey % 56 AS INT) AS age,"
        " CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender,"
        " lower(c_mktsegment) AS occupation,"
        " lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') AS zip_code FROM customer",
    ),
    "seq_d": ([], "SELECT user_id, event_id AS seq, event_type, value FROM events"),
    "factors_d": (
        [],
        "SELECT CAST(vec_id AS INT) AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
    ),
    "average_d": (
        ["ratings_d"],
        "SELECT movie_id, avg(rating) AS avg_rating FROM ratings_d GROUP BY movie_id",
    ),
    "catalogue_d": (
        ["movies_d", "average_d"],
        f"SELECT movie_id, title, {_GENRES_SQL} AS genres,"
        " CAST(try_strptime(release_date, '%d-%b-%Y') AS DATE) AS release_date, avg_rating"
        " FROM movies_d LEFT JOIN average_d USING (movie_id)",
    ),
    "scored_d": (
        ["factors_d"],
        "SELECT u.id AS user_id, i.id AS movie_id,"
        " round(list_dot_product(u.features, i.features), 6) AS score"
        " FROM factors_d u CROSS JOIN factors_d i",
    ),
    "ranked_d": (
        ["scored_d"],
        "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id"
        " ORDER BY score DESC, movie_id) AS INT) AS rank FROM scored_d) WHERE rank <= 10",
    ),
    "listed_d": (
        ["ranked_d"],
        "SELECT user_id, rank, movie_id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS rating"
        " FROM ranked_d",
    ),
    "predicted_d": (
        ["ratings_d", "factors_d"],
        "SELECT user_id, movie_id, rating, list_dot_product(u.features, i.features) AS prediction"
        " FROM ratings_d JOIN factors_d u ON user_id = u.id JOIN factors_d i ON movie_id = i.id",
    ),
}


def with_views(names: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named views, what they need, and ``extra`` views in order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
