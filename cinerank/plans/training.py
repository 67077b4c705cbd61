"""Split, train, score and store a model; publish its lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinerank.operators import als
from cinerank.operators.evaluate import metric_row, rmse
from cinerank.operators.splits import random_split
from cinerank.session import materialise
from cinerank.sinks.tables import append_metrics, publish, publish_by_film
from cinerank.sources.schemas import RECOMMENDATIONS


def train(
    ratings: DataFrame,
    model_path: str,
    run_id: str,
    seed: int = 0,
    metrics_path: str | None = None,
    **params,
) -> DataFrame:
    """Train on 80 %, save the model, return the metrics row for the other 20 %.

    With ``metrics_path`` the row is also kept in the table of all runs there.
    """
    training, test = random_split(ratings, 0.8, seed)
    model = als.fit(training, seed=seed, **params)
    als.save(model, model_path)
    stored = als.load(model_path)
    scored = rmse(als.predict(stored, test))
    row = materialise(metric_row(scored, run_id, seed=seed, rank=stored.rank), "metrics")
    if metrics_path is not None:
        append_metrics(row, metrics_path)
    return row


def publish_pipeline(
    spark: SparkSession, model_path: str, table_path: str, seen: DataFrame | None = None
) -> DataFrame:
    """Score every user of a stored model and publish the lists, by user and by film.

    Films rated already are listed too, unless ``seen`` (user_id, movie_id) names them.
    """
    # Publishing stores the lists, so they are made once and stored no second time here.
    publish(als.recommendations(als.load(model_path), seen=seen), f"{table_path}/by_user")
    lists = spark.read.schema(RECOMMENDATIONS).parquet(f"{table_path}/by_user")
    publish_by_film(lists, f"{table_path}/by_film")
    return lists
