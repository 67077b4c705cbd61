"""Sources and sinks: written to the shared folder by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank import sinks, sources
from cinerank.functions import document_json
from cinerank.operators.topk import explode_list
from cinerank.session import scratch_path
from cinerank.sources import schemas
from entry_queries import views
from entry_queries.registry import query
from entry_queries.views import with_views

_RATINGS = 'SELECT user_id, movie_id, rating, "timestamp" FROM ratings_d'


@query(
    "scan_psv_schema",
    with_views(
        "movies_d",
        "SELECT * REPLACE (nullif(release_date, '') AS release_date) FROM movies_d",
    ),
)
def scan_psv_schema(spark, d):
    path = scratch_path(spark, "items")
    views.movies(spark, d).write.csv(path, sep="|", encoding="ISO-8859-1", emptyValue="")
    return sources.read_movies(spark, path)


@query("scan_tsv_ratings", with_views("ratings_d", _RATINGS))
def scan_tsv_ratings(spark, d):
    path = scratch_path(spark, "ratings")
    views.ratings(spark, d).write.csv(path, sep="\t")
    return sources.read_ratings(spark, path)


@query("scan_psv_users", with_views("users_d", "SELECT * FROM users_d"))
def scan_psv_users(spark, d):
    path = scratch_path(spark, "users")
    views.users(spark, d).write.csv(path, sep="|")
    return sources.read_users(spark, path)


@query("scan_csv_header", with_views("ratings_d", _RATINGS))
def scan_csv_header(spark, d):
    path = scratch_path(spark, "ratings-header")
    sinks.write_csv(views.ratings(spark, d), path)
    return sources.read_csv_table(spark, path, schemas.RATINGS)


@query("scan_multi_file", with_views("ratings_d", _RATINGS))
def scan_multi_file(spark, d):
    ratings = views.ratings(spark, d)
    path = scratch_path(spark, "by-rating")
    parts = ratings.withColumn("part", F.coalesce(F.col("rating").cast("string"), F.lit("none")))
    parts.write.partitionBy("part").csv(path, sep="\t")
    written = [row["part"] for row in parts.select("part").distinct().collect()]
    return sources.read_ratings(spark, [f"{path}/part={part}" for part in written])


@query("rows_from_request", "SELECT CAST(c_custkey AS INT) AS user_id FROM customer")
def rows_from_request(spark, d):
    keys = views.table(spark, d, "customer").select("c_custkey")
    return sources.requests_frame(spark, keys, "user_id", T.IntegerType())


@query(
    "require_inputs",
    "SELECT 'part' AS name, count(*) AS n_rows FROM part UNION ALL"
    " SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def require_inputs(spark, d):
    names = ["part", "orders", "lineitem"]
    sources.require_inputs(spark, [f"{d}/{name}.parquet" for name in names])
    counts = [
        views.table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        for name in names
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_CATALOGUE = (
    "SELECT movie_id, title, genres, release_date,"
    " round(CAST(CAST(avg_rating AS FLOAT) AS DOUBLE), 4) AS avg_rating FROM catalogue_d"
)


def _comparable(stored):
    return stored.withColumn("avg_rating", F.round(F.col("avg_rating").cast("double"), 4))


# In CSV an empty text and a missing one are the same.
@query("sink_csv", with_views("catalogue_d", _CATALOGUE.replace(" genres,", " nullif(genres, '') AS genres,")))
def sink_csv(spark, d):
    path = scratch_path(spark, "catalogue-csv")
    sinks.write_csv(sinks.conform(views.catalogue(spark, d), schemas.CATALOGUE), path)
    return _comparable(sources.read_csv_table(spark, path, schemas.CATALOGUE))


@query("ensure_table", with_views("catalogue_d", _CATALOGUE))
def ensure_table(spark, d):
    """Creates the empty table once; asking again keeps the rows written since."""
    path = scratch_path(spark, "catalogue")
    sinks.ensure_table(spark, path, schemas.CATALOGUE)
    rows = sinks.conform(views.catalogue(spark, d), schemas.CATALOGUE)
    rows.write.mode("append").parquet(path)
    sinks.ensure_table(spark, path, schemas.CATALOGUE)
    return _comparable(sources.read_table(spark, path, schemas.CATALOGUE))


_LISTED = "SELECT user_id, rank, movie_id, rating FROM listed_d"


def _listed(stored):
    return explode_list(stored).withColumn("rating", F.col("rating").cast("double"))


@query("rebuild_table", with_views("listed_d", _LISTED))
def rebuild_table(spark, d):
    """What was there before, of another shape, is gone."""
    path = scratch_path(spark, "lists")
    sinks.write_table(views.users(spark, d), path)
    sinks.rebuild_table(views.lists(spark, d), path, schemas.RECOMMENDATIONS)
    return _listed(sources.read_table(spark, path, schemas.RECOMMENDATIONS))


@query("publish_recs", with_views("listed_d", _LISTED))
def publish_recs(spark, d):
    path = scratch_path(spark, "published")
    lists = views.lists(spark, d)
    sinks.publish(lists, path)
    sinks.publish(lists, path)  # publishing again replaces, it does not append
    return _listed(sources.read_table(spark, path, schemas.RECOMMENDATIONS))


@query("publish_by_film", with_views("listed_d", "SELECT movie_id, user_id, rank, rating FROM listed_d"))
def publish_by_film(spark, d):
    path = scratch_path(spark, "by-film")
    sinks.publish_by_film(views.lists(spark, d), path)
    return sources.read_table(spark, path).select(
        "movie_id", "user_id", "rank", F.col("rating").cast("double").alias("rating")
    )


@query(
    "upsert_by_key",
    "SELECT c_custkey AS user_id, coalesce(total, c_acctbal) AS amount FROM customer"
    " LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders"
    " WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey",
)
def upsert_by_key(spark, d):
    old = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("amount")
    )
    orders = views.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    new = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount")
    )
    # Each key is written twice in one batch; the second write is the one that holds.
    first = new.withColumn("amount", F.lit(-1.0)).withColumn("written", F.lit(1))
    batch = first.unionByName(new.withColumn("written", F.lit(2)))
    path = scratch_path(spark, "upserted")
    sinks.write_table(sinks.upsert(old, batch, "user_id", "written"), path)
    return sources.read_table(spark, path)


@query(
    "upsert_parts",
    "SELECT c_custkey AS user_id, coalesce(total, c_acctbal) AS amount FROM customer"
    " LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders"
    " WHERE o_orderkey % 50 = 0 GROUP BY o_custkey) ON o_custkey = c_custkey",
)
def upsert_parts(spark, d):
    """The same into a table of 64 folders by key, of which those without a change stay."""
    path = scratch_path(spark, "keyed")
    old = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("amount")
    )
    sinks.create_keyed_table(old, path, "user_id", 64)
    # Orders whose key fifty divides are the batch of changes.
    changed = views.table(spark, d, "orders").filter("o_orderkey % 50 = 0")
    new = changed.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount")
    )
    sinks.upsert_into(new, path, "user_id", 64)
    return spark.read.parquet(path).select("user_id", "amount")


@query("publish_version", with_views("listed_d", _LISTED))
def publish_version_query(spark, d):
    """Lists published twice as versions; the current one is read."""
    path = scratch_path(spark, "versions")
    lists = views.published(spark, d)[0]
    sinks.publish_version(lists.limit(1), path, buckets=4)
    sinks.publish_version(lists, path, buckets=8)
    return _listed(sinks.published_lists(spark, path))


@query("docs_json", with_views("listed_d", _LISTED))
def docs_json(spark, d):
    """Documents as JSON text, parsed back so that fields rather than spelling compare."""
    documents = views.lists(spark, d).select(document_json("user_id", "recommendations").alias("doc"))
    parsed = documents.select(F.from_json("doc", schemas.RECOMMENDATIONS).alias("doc")).select("doc.*")
    return _listed(parsed)


@query(
    "docs_json_lines",
    "SELECT doc_id, lang, source, n_chars, text FROM documents",
)
def docs_json_lines(spark, d):
    """Whole documents stored as JSON lines and read back under their schema."""
    path = scratch_path(spark, "documents-json")
    documents = views.table(spark, d, "documents")
    documents.select(document_json(*documents.columns).alias("value")).write.text(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema])
    return spark.read.schema(schema).json(path)
