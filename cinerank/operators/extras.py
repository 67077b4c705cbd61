"""Search-side operators: moments, parent-child, stored queries, rank quality, pins."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.functions.text import tokenise, wildcard_to_like
from cinerank.operators.skew import lookup_join
from cinerank.operators.topk import first_k
from cinerank.session import materialise


def matrix_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair of fields (x <= y in the given order) over rows where all are set.

    Moments are population moments, covariance is the sample's.  One pass over
    the table computes every field and pair.
    """
    rows = df.select(*columns).dropna()
    single = [
        F.struct(
            F.lit(c).alias("field"),
            F.count("*").alias("count"),
            F.avg(c).alias("mean"),
            F.var_samp(c).alias("variance"),
            F.skewness(c).alias("skewness"),
            F.kurtosis(c).alias("kurtosis"),
        )
        for c in columns
    ]
    pairs = [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            F.covar_samp(x, y).alias("covariance"),
            F.corr(x, y).alias("correlation"),
        )
        for x, y in combinations(columns, 2)
    ]
    summary = rows.agg(F.array(*single).alias("fields"), F.array(*pairs).alias("pairs"))
    fields = summary.select(F.inline("fields"), "pairs")
    return fields.select(
        "field", "count", "mean", "variance", "skewness", "kurtosis",
        F.explode_outer(F.filter("pairs", lambda p: p["x"] == F.col("field"))).alias("pair"),
    ).select(
        "field", "count", "mean", "variance", "skewness", "kurtosis",
        F.col("pair.y").alias("other"), "pair.covariance", "pair.correlation",
    )


def has_child(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with at least one of ``children``.  Child keys are made distinct first."""
    keys = children.select(key).distinct()
    return lookup_join(parents, keys, key, "left_semi", computed=True)


def children_aggregate(
    parents: DataFrame, children: DataFrame, key: str, group: str, measure: str
) -> DataFrame:
    """Number and sum of children per group of parents; children are summed per parent first."""
    per_parent = children.groupBy(key).agg(
        F.count("*").alias("_n"), F.sum(measure).alias("_total")
    )
    return (
        parents.select(key, group)
        .join(per_parent, key)
        .groupBy(group)
        .agg(F.sum("_n").alias("n_children"), F.sum("_total").alias("total"))
    )


def percolate(
    documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str
) -> DataFrame:
    """(query_id, doc_id) where the document holds every term of the stored query.

    Documents meet a query only through its rarest term, and the survivors are
    checked against the query's other terms; a term that every document holds
    pairs nothing unless a query has no other.
    """
    occurrences = materialise(
        documents.select(
            F.col(doc_id).alias("doc_id"),
            F.explode(F.array_distinct(tokenise(F.col(text)))).alias("term"),
        ),
        "percolate-terms",
    )
    stored = materialise(
        queries.select(
            F.col(query_id).alias("query_id"),
            F.explode(F.array_distinct(tokenise(F.col(query)))).alias("term"),
        ),
        "stored-queries",
    )
    frequency = occurrences.groupBy("term").agg(F.count("*").alias("df"))
    counted = lookup_join(stored, frequency, "term", "left", computed=True)
    counted = materialise(counted.withColumn("df", F.coalesce("df", F.lit(0))), "query-terms")
    rarest = first_k(counted, 1, "query_id", ["df", "term"]).select("query_id", "term")
    candidates = lookup_join(occurrences, rarest, "term", computed=True).select(
        "query_id", "doc_id"
    )
    sizes = counted.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    # One row per candidate and query term, kept when the document holds the term.
    needed = lookup_join(candidates, counted.select("query_id", "term"), "query_id")
    held = needed.join(occurrences, ["doc_id", "term"], "left_semi")
    return (
        held.groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("n_held"))
        .join(sizes, "query_id")
        .filter(F.col("n_held") == F.col("n_terms"))
        .select("query_id", "doc_id")
    )


def rank_quality(
    ranked: DataFrame,
    relevant: DataFrame,
    k: int,
    group: str,
    item: str,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Per group: precision@k, recall@k, reciprocal rank and NDCG@k with 0/1 relevance.

    ``ranked`` has (group, item, rank), ``relevant`` distinct (group, item).  When
    the relevant items are too many to list, ``relevant`` may hold only those
    that are ranked, with ``totals`` (group, n_relevant) giving their number.
    """
    if totals is None:
        totals = relevant.groupBy(group).agg(F.count("*").alias("n_relevant"))
    listed = ranked.filter(F.col("rank") <= k).select(group, item, "rank")
    marked = listed.join(relevant.select(group, item).withColumn("_hit", F.lit(1)), [group, item], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(0))
    gain = hit / F.log2(F.col("rank") + 1.0)
    per_group = marked.groupBy(group).agg(
        F.sum(hit).alias("n_hits"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("_first"),
        F.sum(gain).alias("_gain"),
    )
    # The best possible gain depends on min(k, n_relevant) alone: a k-entry array.
    ideal = F.expr(
        f"aggregate(sequence(1, least({k}, int(n_relevant))), 0D, (s, i) -> s + 1 / log2(i + 1.0D))"
    )
    return (
        totals.join(per_group, group, "left")
        .select(
            group,
            (F.coalesce("n_hits", F.lit(0)) / k).alias("precision"),
            (F.coalesce("n_hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
            F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
            (F.coalesce("_gain", F.lit(0.0)) / ideal).alias("ndcg"),
        )
    )


def pinned(hits: DataFrame, pins: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Pinned items first in their given order, then scored hits; an item appears once.

    ``hits`` has (group, item, score), ``pins`` has (group, item, place).
    """
    either = hits.select(group, item, "score", F.lit(None).cast("int").alias("place")).unionByName(
        pins.select(group, item, F.lit(None).cast("double").alias("score"), F.col("place").cast("int"))
    )
    merged = either.groupBy(group, item).agg(
        F.max("score").alias("score"), F.min("place").alias("place")
    )
    order = [F.asc_nulls_last("place"), F.desc_nulls_last("score"), F.col(item)]
    return first_k(merged, k, group, order)


def reindex(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Copy with ``changes`` applied to the rows that meet ``condition``."""
    return df.withColumns(
        {
            name: F.when(condition, value).otherwise(F.col(name))
            for name, value in changes.items()
        }
    )


def metric_summary(value: str, name: str = "metric") -> Column:
    """min, max, sum and count as one struct column."""
    return F.struct(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
    ).alias(name)


def merge_summaries(name: str = "metric") -> Column:
    """The summary of a coarser group from the summaries of finer ones."""
    return F.struct(
        F.min(f"{name}.min").alias("min"),
        F.max(f"{name}.max").alias("max"),
        F.sum(f"{name}.sum").alias("sum"),
        F.sum(f"{name}.count").alias("count"),
    ).alias(name)


def wildcard(column: Column, pattern: str) -> Column:
    """Whole-value match with `*` and `?`."""
    return F.like(column, wildcard_to_like(F.lit(pattern)))
