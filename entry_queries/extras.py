"""Moments, parent-child, stored queries, rank quality, pins, vectors, wildcards."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.functions import tokenise
from cinerank.operators import extras
from cinerank.operators.factors import nearest_vectors
from cinerank.operators.stored_queries import match_patterns, percolate_stored
from cinerank.session import scratch_path
from cinerank.sinks import copied_table, copy_into, refused_rows
from entry_queries import views
from entry_queries.registry import query
from entry_queries.views import tokens_sql, with_views

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _moments_sql() -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in _NUMBERS)
    parts = []
    for i, c in enumerate(_NUMBERS):
        delta = f"({c} - m_{c})"
        single = (
            f"'{c}' AS field, count(*) AS count, round(avg({c}), 6) AS mean,"
            f" round(var_samp({c}) / greatest(avg({c}) * avg({c}), 1e-12), 6) AS variance,"
            f" round(avg(pow{delta[:-1]}, 3)) / pow(var_pop({c}), 1.5), 6) AS skewness,"
            f" round(avg(pow{delta[:-1]}, 4)) / pow(var_pop({c}), 2) - 3, 6) AS kurtosis"
        )
        others = _NUMBERS[i + 1 :]
        if not others:
            parts.append(
                f"SELECT {single}, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS DOUBLE) AS"
                " covariance, CAST(NULL AS DOUBLE) AS correlation FROM lineitem, means"
            )
        for o in others:
            parts.append(
                f"SELECT {single}, '{o}' AS other, round(covar_samp({c}, {o}), 3) + 0.0"
                " AS covariance,"
                f" round(corr({c}, {o}), 6) AS correlation FROM lineitem, means"
            )
    return f"WITH means AS (SELECT {means} FROM lineitem) " + " UNION ALL ".join(parts)


@query("x_matrix_stats", _moments_sql())
def x_matrix_stats(spark, d):
    stats = extras.matrix_stats(views.table(spark, d, "lineitem"), _NUMBERS)
    # Variance is shown relative to the squared mean: prices and taxes differ by ten orders.
    relative = F.col("variance") / F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-12))
    return stats.withColumns(
        {
            "variance": F.round(relative, 6),
            "mean": F.round("mean", 6),
            "skewness": F.round("skewness", 6),
            "kurtosis": F.round("kurtosis", 6),
            "covariance": F.round("covariance", 3) + 0.0,
            "correlation": F.round("correlation", 6),
        }
    )


@query(
    "x_has_child",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem"
    " WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def x_has_child(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    returned = views.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    return extras.has_child(
        orders, returned.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"
    )


@query(
    "x_children_agg",
    "SELECT o_orderpriority, count(*) AS n_children, round(sum(l_quantity), 2) AS total"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
)
def x_children_agg(spark, d):
    lines = views.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    result = extras.children_aggregate(
        views.table(spark, d, "orders"), lines, "o_orderkey", "o_orderpriority", "l_quantity"
    )
    return result.withColumn("total", F.round("total", 2))


@query(
    "x_percolate",
    f"WITH q AS (SELECT item_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),"
    " sizes AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),"
    f" d AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents),"
    " held AS (SELECT item_id, doc_id, count(*) AS n FROM q JOIN d USING (term)"
    " GROUP BY item_id, doc_id)"
    " SELECT item_id AS query_id, doc_id FROM held JOIN sizes USING (item_id, n)",
)
def x_percolate(spark, d):
    """Benchmark passages as stored queries: which documents hold all words of which passage."""
    stored = views.table(spark, d, "benchmark")
    documents = views.table(spark, d, "documents")
    return extras.percolate(documents, "doc_id", "text", stored, "item_id", "text")


# Three quarters of a passage's different words are asked for.
_LEAST = "CAST(ceil(n * 0.75) AS INT)"
_PERCOLATE = (
    f"q AS (SELECT item_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),"
    f" sizes AS (SELECT item_id, {_LEAST} AS least FROM"
    " (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)),"
    f" d AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents),"
    " held AS (SELECT item_id, doc_id, CAST(count(*) AS INT) AS n_held FROM q JOIN d USING (term)"
    " GROUP BY item_id, doc_id)"
)


@query(
    "x_percolate_least",
    f"WITH {_PERCOLATE} SELECT item_id AS query_id, doc_id, n_held FROM held JOIN sizes USING (item_id)"
    " WHERE n_held >= least",
)
def x_percolate_least(spark, d):
    """Documents that hold three quarters of the different words of a passage."""
    n_terms = F.size(F.array_distinct(tokenise(F.col("text"))))
    stored = views.table(spark, d, "benchmark").withColumn(
        "least", F.ceil(n_terms * F.lit(0.75)).cast("int")
    )
    documents = views.table(spark, d, "documents")
    return percolate_stored(documents, "doc_id", "text", stored, "item_id", "text", "least")


@query(
    "x_percolate_phrase",
    f"WITH p AS (SELECT item_id, array_to_string(({tokens_sql('text')})[1:8], ' ') AS phrase FROM benchmark),"
    f" d AS (SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS body FROM documents)"
    " SELECT item_id AS query_id, doc_id FROM p JOIN d"
    " ON contains(concat(' ', body, ' '), concat(' ', phrase, ' '))",
)
def x_percolate_phrase(spark, d):
    """Documents in which the first eight words of a passage stand side by side."""
    first = F.array_join(F.slice(tokenise(F.col("text")), 1, 8), " ")
    stored = views.table(spark, d, "benchmark").select(
        "item_id", first.alias("phrase"), F.lit(True).alias("in_order")
    )
    documents = views.table(spark, d, "documents")
    found = percolate_stored(
        documents, "doc_id", "text", stored, "item_id", "phrase", phrase="in_order"
    )
    return found.drop("n_held")


# The listed neighbours of a vector are right when they carry its label.
_QUALITY = with_views(
    "ranked_d",
    "SELECT user_id, round(n_hits / 10.0, 6) AS precision, round(n_hits / n_relevant, 6) AS recall,"
    " round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank,"
    " round(gain / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_relevant), 6)"
    " AS ndcg FROM per_user JOIN sizes USING (label)",
    hits="SELECT r.user_id, r.rank, u.label, CASE WHEN u.label = i.label THEN 1 ELSE 0 END AS hit"
    " FROM ranked_d r JOIN embeddings u ON r.user_id = u.vec_id JOIN embeddings i"
    " ON r.movie_id = i.vec_id",
    per_user="SELECT user_id, label, CAST(sum(hit) AS DOUBLE) AS n_hits,"
    " min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit / log2(rank + 1)) AS gain FROM hits"
    " GROUP BY user_id, label",
    sizes="SELECT label, count(*) AS n_relevant FROM embeddings GROUP BY label",
)


@query("x_rank_eval", _QUALITY)
def x_rank_eval(spark, d):
    """Relevance is equality of labels, so it is tested on the lists and counted per label."""
    labels = views.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("id"), "label")
    own = labels.select(F.col("id").alias("user_id"), F.col("label").alias("group_label"))
    other = labels.select(F.col("id").alias("movie_id"), "label")
    marked = views.ranked(spark, d).join(own, "user_id").join(other, "movie_id")
    relevant = marked.filter(F.col("label") == F.col("group_label")).select("user_id", "movie_id")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n_relevant"))
    totals = own.join(sizes, own.group_label == sizes.label).select("user_id", "n_relevant")
    scored = extras.rank_quality(
        marked.select("user_id", "movie_id", "rank"), relevant, 10, "user_id", "movie_id", totals
    )
    return scored.select("user_id", *[F.round(c, 6).alias(c) for c in scored.columns[1:]])


@query(
    "x_pinned",
    with_views(
        "ranked_d",
        "SELECT CAST(user_id AS INT) AS user_id, CAST(movie_id AS INT) AS movie_id, score, place, rank"
        " FROM (SELECT *, CAST(row_number() OVER"
        " (PARTITION BY user_id ORDER BY place NULLS LAST, score DESC NULLS LAST, movie_id) AS INT)"
        " AS rank FROM merged) WHERE rank <= 10",
        pins="SELECT u.vec_id AS user_id, i.first AS movie_id, 1 AS place FROM embeddings u JOIN"
        " (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label) i USING (label)",
        merged="SELECT user_id, movie_id, max(score) AS score, CAST(min(place) AS INT) AS place FROM ("
        "SELECT user_id, movie_id, score, NULL AS place FROM ranked_d UNION ALL"
        " SELECT user_id, movie_id, NULL, place FROM pins) GROUP BY user_id, movie_id",
    ),
)
def x_pinned(spark, d):
    """The first vector of a label is pinned for every vector of that label."""
    labels = views.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("user_id"), "label")
    first = labels.groupBy("label").agg(F.min("user_id").alias("movie_id"))
    pins = labels.join(first, "label").select("user_id", "movie_id", F.lit(1).alias("place"))
    return extras.pinned(views.ranked(spark, d), pins, "user_id", "movie_id", 10)


@query(
    "x_reindex",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS"
    " o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 2, 2)"
    " ELSE o_totalprice END AS o_totalprice FROM orders",
)
def x_reindex(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return extras.reindex(
        orders,
        F.col("o_orderstatus") == "O",
        {
            "o_orderstatus": F.lit("open"),
            "o_totalprice": F.round(F.col("o_totalprice") * 2, 2),
        },
    )


@query(
    "x_reindex_versions",
    "SELECT o_orderkey, o_orderstatus = 'F' AND year(o_orderdate) >= 1995 AS refused,"
    " CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) >= 1995 THEN o_totalprice"
    " ELSE -o_totalprice END AS o_totalprice, CAST(CASE WHEN o_orderstatus = 'F'"
    " AND year(o_orderdate) >= 1995 THEN year(o_orderdate) ELSE 1995 END AS INT) AS version"
    " FROM orders",
)
def x_reindex_versions(spark, d):
    """Finished orders are held at the version of their year; then all orders are copied as of
    1995, in slices, with a stop between."""
    path = scratch_path(spark, "copied")
    orders = views.table(spark, d, "orders")
    held = orders.filter(F.col("o_orderstatus") == "F").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("version")
    )
    copy_into(held, path, "o_orderkey", "version", "finished", slices=4)
    every = orders.select(
        "o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"), F.lit(1995).alias("version")
    )
    for slices in (1, None):
        copy_into(every, path, "o_orderkey", "version", "all", slices=4, at_most=slices)
    kinds = "o_orderkey long, version int, held_version int"
    refused = refused_rows(spark, path, "all", kinds).select(
        "o_orderkey", F.lit(True).alias("refused")
    )
    table = copied_table(spark, path, every.schema)
    return table.join(refused, "o_orderkey", "left").fillna(False, "refused")


@query(
    "x_preagg_metric",
    "SELECT event_type, min(value) AS lowest, max(value) AS highest, round(sum(value), 2) AS total,"
    " count(value) AS n FROM events GROUP BY event_type",
)
def x_preagg_metric(spark, d):
    """Summaries per user and type, merged to summaries per type."""
    fine = views.table(spark, d, "events").groupBy("user_id", "event_type").agg(
        extras.metric_summary("value")
    )
    coarse = fine.groupBy("event_type").agg(extras.merge_summaries())
    return coarse.select(
        "event_type",
        F.col("metric.min").alias("lowest"),
        F.col("metric.max").alias("highest"),
        F.round("metric.sum", 2).alias("total"),
        F.col("metric.count").alias("n"),
    )


def _nearest_sql(expression: str, name: str, order: str) -> str:
    return with_views(
        "factors_d",
        f"SELECT user_id, movie_id, {name}, rank FROM (SELECT *, CAST(row_number() OVER"
        f" (PARTITION BY user_id ORDER BY {name} {order}, movie_id) AS INT) AS rank FROM pairs)"
        " WHERE rank <= 10",
        pairs=f"SELECT u.id AS user_id, i.id AS movie_id, round({expression}, 6) AS {name}"
        " FROM factors_d u CROSS JOIN factors_d i",
    )


@query(
    "x_vector_topk_cosine",
    _nearest_sql("list_cosine_similarity(u.features, i.features)", "score", "DESC"),
)
def x_vector_topk_cosine(spark, d):
    vectors = views.factors(spark, d)
    return nearest_vectors(vectors, vectors, 10, "cosine")


@query(
    "x_vector_topk",
    _nearest_sql("list_distance(u.features, i.features)", "distance", "ASC"),
)
def x_vector_topk(spark, d):
    vectors = views.factors(spark, d)
    return nearest_vectors(vectors, vectors, 10, "l2")


@query(
    "x_wildcard",
    "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#%7_'",
)
def x_wildcard(spark, d):
    customers = views.table(spark, d, "customer").select("c_custkey", "c_name")
    return customers.filter(extras.wildcard(F.col("c_name"), "*#*7?"))


# Patterns of a table: each supplier's key as the end of a customer's name.
@query(
    "x_wildcard_table",
    "SELECT s_suppkey, c_name FROM supplier JOIN customer"
    " ON c_name LIKE concat('%#%', CAST(s_suppkey % 100 AS VARCHAR), '_')",
)
def x_wildcard_table(spark, d):
    """Which customers' names match which supplier's pattern, met by rare pieces."""
    patterns = views.table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("*#*"), (F.col("s_suppkey") % 100).cast("string"), F.lit("?")).alias("pattern")
    )
    customers = views.table(spark, d, "customer")
    found = match_patterns(customers, "c_name", patterns, "s_suppkey", "pattern", every=True)
    return found.select(F.col("pattern_id").alias("s_suppkey"), F.col("value").alias("c_name"))
