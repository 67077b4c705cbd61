"""Factor scoring, rankings and accuracy on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.functions import dot
from cinerank.operators.catalogue import with_titles
from cinerank.operators.evaluate import metric_row, rmse
from cinerank.operators.factors import predict_pairs, recommendation_lists, top_k_unseen
from cinerank.operators.topk import explode_list, top_k
from cinerank.session import scratch_path
from cinerank.sinks import append_metrics, read_metrics
from entry_queries import views
from entry_queries.registry import query
from entry_queries.views import with_views


@query(
    "fn_dot",
    with_views(
        "ratings_d factors_d",
        "SELECT user_id, movie_id, round(list_dot_product(u.features, i.features), 6) AS score"
        " FROM (SELECT DISTINCT user_id, movie_id FROM ratings_d)"
        " JOIN factors_d u ON user_id = u.id JOIN factors_d i ON movie_id = i.id",
    ),
)
def fn_dot(spark, d):
    pairs = views.ratings(spark, d).select("user_id", "movie_id").distinct()
    vectors = views.factors(spark, d)
    users = vectors.select(F.col("id").alias("user_id"), F.col("features").alias("u"))
    items = vectors.select(F.col("id").alias("movie_id"), F.col("features").alias("i"))
    joined = pairs.join(users, "user_id").join(items, "movie_id")
    return joined.select("user_id", "movie_id", F.round(dot(F.col("u"), F.col("i")), 6).alias("score"))


@query("join_cross_score", with_views("ranked_d", "SELECT user_id, movie_id, score, rank FROM ranked_d"))
def join_cross_score(spark, d):
    return views.ranked(spark, d)


@query(
    "join_predict",
    with_views(
        "predicted_d",
        "SELECT user_id, movie_id, rating, round(prediction, 6) AS prediction FROM predicted_d",
    ),
)
def join_predict(spark, d):
    vectors = views.factors(spark, d)
    pairs = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    predicted = predict_pairs(pairs, vectors, vectors)
    return predicted.withColumn("prediction", F.round("prediction", 6))


@query(
    "agg_rmse",
    with_views(
        "predicted_d",
        "SELECT round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse, count(*) AS n_pairs"
        " FROM predicted_d",
    ),
)
def agg_rmse(spark, d):
    vectors = views.factors(spark, d)
    scored = rmse(predict_pairs(views.ratings(spark, d), vectors, vectors, rank=64))
    return scored.withColumn("rmse", F.round("rmse", 6))


@query(
    "metric_row",
    with_views(
        "predicted_d",
        "SELECT 'factors' AS run_id, 64 AS rank, 0.1 AS reg_param,"
        " round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse, count(*) AS n_pairs"
        " FROM predicted_d",
    ).replace("0.1 AS reg_param", "CAST(0.1 AS DOUBLE) AS reg_param"),
)
def metric_row_query(spark, d):
    vectors = views.factors(spark, d)
    scored = rmse(predict_pairs(views.ratings(spark, d), vectors, vectors, rank=64))
    row = metric_row(scored, "factors", rank=64, reg_param=0.1)
    return row.withColumn("rmse", F.round("rmse", 6))


@query(
    "agg_topk_list",
    with_views(
        "listed_d",
        "SELECT user_id, CAST(count(*) AS INT) AS n, string_agg(CAST(movie_id AS VARCHAR), ','"
        " ORDER BY rank) AS movie_ids FROM listed_d GROUP BY user_id",
    ),
)
def agg_topk_list(spark, d):
    return recommendation_lists(views.ranked(spark, d)).select(
        "user_id",
        F.size("recommendations").alias("n"),
        F.array_join(F.col("recommendations.movie_id").cast("array<string>"), ",").alias("movie_ids"),
    )


@query(
    "win_topk_user",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating, \"timestamp\", rank FROM (SELECT *, CAST(row_number() OVER"
        " (PARTITION BY user_id ORDER BY rating DESC, movie_id, \"timestamp\") AS INT) AS rank"
        " FROM ratings_d) WHERE rank <= 10",
    ),
)
def win_topk_user(spark, d):
    return top_k(views.ratings(spark, d), 10, "user_id", "rating", ["movie_id", "timestamp"])


@query(
    "topk_user_subset",
    with_views(
        "ranked_d",
        "SELECT user_id, movie_id, score, rank FROM ranked_d WHERE user_id IN"
        " (SELECT CAST(s_suppkey AS INT) FROM supplier)",
    ),
)
def topk_user_subset(spark, d):
    from cinerank.operators.factors import top_k_items
    from cinerank.operators.skew import lookup_join

    wanted = views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("id"))
    vectors = views.factors(spark, d)
    return top_k_items(lookup_join(vectors, wanted, "id", "left_semi"), vectors, 10)


@query(
    "join_lookup_title",
    with_views(
        "listed_d movies_d",
        "SELECT user_id, rank, movie_id, rating, coalesce(title, 'Unknown') AS title"
        " FROM listed LEFT JOIN movies_d USING (movie_id)",
        listed="SELECT user_id, rank, movie_id, rating FROM listed_d UNION ALL"
        " SELECT CAST(s_suppkey AS INT), 1, CAST(-1 - s_suppkey AS INT), 0 FROM supplier",
    ),
)
def join_lookup_title(spark, d):
    """List entries, and one of each supplier for a film that there is not."""
    rows = explode_list(views.lists(spark, d)).withColumn("rating", F.col("rating").cast("double"))
    strange = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("int").alias("user_id"),
        F.lit(1).alias("rank"),
        (-1 - F.col("s_suppkey")).cast("int").alias("movie_id"),
        F.lit(0.0).alias("rating"),
    )
    return with_titles(rows.unionByName(strange), views.movies(spark, d))


@query(
    "rename_nested",
    with_views(
        "listed_d movies_d",
        "SELECT user_id, string_agg(concat(movie_id, ':', coalesce(title, 'Unknown')), ','"
        " ORDER BY rank) AS titled, max(rating) AS best, min(rating) AS least"
        " FROM listed_d LEFT JOIN movies_d USING (movie_id) GROUP BY user_id",
    ),
)
def rename_nested(spark, d):
    from cinerank.operators.topk import as_ranked_list

    rows = with_titles(explode_list(views.lists(spark, d)), views.movies(spark, d))
    named = rows.withColumnRenamed("rating", "predicted_rating")
    nested = as_ranked_list(named, "user_id", ["movie_id", "title", "predicted_rating"], "films")
    return nested.select(
        "user_id",
        F.array_join(
            F.transform("films", lambda f: F.concat_ws(":", f["movie_id"], f["title"])), ","
        ).alias("titled"),
        F.col("films")[0]["predicted_rating"].cast("double").alias("best"),
        F.element_at("films", -1)["predicted_rating"].cast("double").alias("least"),
    )


@query(
    "metric_history",
    with_views(
        "predicted_d",
        "SELECT CASE WHEN high THEN 'high' ELSE 'low' END AS run_id, CASE WHEN high THEN 64 END AS rank,"
        " round(sqrt(avg(pow(rating - prediction, 2))), 6) AS rmse, count(*) AS n_pairs"
        " FROM (SELECT *, rating >= 3 AS high FROM predicted_d) GROUP BY high",
    ),
)
def metric_history(spark, d):
    """Two runs' rows kept in one table; one names a parameter that the other does not."""
    vectors = views.factors(spark, d)
    predicted = predict_pairs(views.ratings(spark, d), vectors, vectors, rank=64)
    path = scratch_path(spark, "metrics")
    append_metrics(metric_row(rmse(predicted.filter("rating >= 3")), "high", rank=64), path)
    append_metrics(metric_row(rmse(predicted.filter("rating < 3")), "low"), path)
    return read_metrics(spark, path).withColumn("rmse", F.round("rmse", 6))


@query(
    "recommend_unseen",
    with_views(
        "scored_d ratings_d",
        "SELECT user_id, movie_id, score, rank FROM (SELECT *, CAST(row_number() OVER"
        " (PARTITION BY user_id ORDER BY score DESC, movie_id) AS INT) AS rank"
        " FROM scored_d ANTI JOIN ratings_d USING (user_id, movie_id)) WHERE rank <= 10",
    ),
)
def recommend_unseen(spark, d):
    """The ten best items of every user that the user has not rated."""
    vectors = views.factors(spark, d)
    return top_k_unseen(vectors, vectors, 10, views.ratings(spark, d))
