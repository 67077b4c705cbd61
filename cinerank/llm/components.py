"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for every node of ``edges`` (u, v).

    Alternates between linking every larger neighbour of a node, and every smaller
    one, to the smallest known, until nothing changes; every path is halved in each
    round.  A round writes its edges, so that a lost executor costs its tasks only.
    """
    links = materialise(
        edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "links"
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = materialise(_star(both, larger=True), "links")
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = materialise(_star(down, larger=False), "links")
        # Two sums over hashes of all edges tell whether the set of edges has changed.
        now = links.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links the neighbours v of each u, and u itself, to the smallest among them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    kept = joined.filter(F.col("v") > F.col("u")) if larger else joined
    linked = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()
