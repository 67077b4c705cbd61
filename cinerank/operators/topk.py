"""Bounded rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.operators.ordinal import group_ordinal


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def first_k(
    df: DataFrame,
    k: int,
    group: str | Sequence[str],
    order_by: Sequence[Column | str],
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group plus ``rank`` 1..k.

    In this form Spark cuts each group to ``k`` rows before the shuffle, so a
    hot group sends ``k`` rows per map task and not all its rows.  Spark does
    this only up to a threshold; for a larger ``k`` groups are numbered in a
    way that bounds each task (``order_by`` should then be unique in a group).
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > threshold:
        numbered = group_ordinal(df, group, order_by, rank).filter(F.col(rank) <= k)
        return numbered.withColumn(rank, F.col(rank).cast("int"))
    window = Window.partitionBy(*_columns(group)).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_k(
    scores: DataFrame,
    k: int,
    group: str | Sequence[str],
    score: str,
    tie: str | Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """``k`` highest scores of each group, equal scores in the order of ``tie``."""
    return first_k(scores, k, group, [F.desc(score), *_columns(tie)], rank)


def as_ranked_list(
    ranked: DataFrame, group: str | Sequence[str], fields: Sequence[str], name: str
) -> DataFrame:
    """One row per group with its ranked rows as an array of structs.

    Groups are at most ``k`` long, which bounds the arrays.
    """
    entries = F.sort_array(F.collect_list(F.struct("rank", *fields)))
    return (
        ranked.groupBy(*_columns(group))
        .agg(entries.alias("_ranked"))
        .withColumn(
            name,
            F.transform(
                "_ranked", lambda e: F.struct(*[e.getField(f).alias(f) for f in fields])
            ),
        )
        .drop("_ranked")
    )


def explode_list(
    recommendations: DataFrame, name: str = "recommendations", rank: str = "rank"
) -> DataFrame:
    """One row per list entry: the other columns, ``rank`` from 1, the entry's fields."""
    others = [c for c in recommendations.columns if c != name]
    return recommendations.select(
        *others, F.posexplode(name).alias("_position", "_entry")
    ).select(*others, (F.col("_position") + 1).alias(rank), "_entry.*")
