"""Queries and patterns that are stored, and met by documents or values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.functions.text import tokenise, wildcard_to_like
from cinerank.operators.skew import lookup_join, materialise_measured, sized_join
from cinerank.operators.topk import first_k
from cinerank.session import materialise

GRAM = 3
# Rows that a task makes of matches.
RESULT_ROWS = 1 << 22
# Marks for the ends of a value; patterns and values do not hold them.
_BEGIN, _END = "\u0002", "\u0003"


def percolate_stored(
    documents: DataFrame,
    doc_id: str,
    text: str,
    queries: DataFrame,
    query_id: str,
    query: str,
    least: str | None = None,
    phrase: str | None = None,
) -> DataFrame:
    """query_id, doc_id, n_held: documents that hold enough of a stored query's terms.

    ``least`` names an int column: how many of the query's n distinct terms a document must
    hold; all of them where it is null or larger, one where it is smaller.  ``phrase``
    names a boolean column: where it is true the query's tokens stand side by side, in
    their order, and ``least`` says nothing.  A query without terms meets nothing.

    Only tokens that some stored query has are kept of the documents.  A document with m
    of n terms has one of the n - m + 1 rarest, so a query meets documents through those
    only, and a term that every document holds pairs nothing unless a query needs it.
    """
    tokens = tokenise(F.col(query))
    n_least = F.lit(None).cast("int") if least is None else F.col(least)
    in_order = F.lit(False) if phrase is None else F.coalesce(phrase, F.lit(False))
    stored = materialise(
        queries.select(
            F.col(query_id).alias("query_id"),
            tokens.alias("tokens"),
            F.array_distinct(tokens).alias("terms"),
            in_order.alias("in_order"),
            n_least.alias("least"),
        ).withColumn(
            "least",
            F.when(F.col("in_order") | F.col("least").isNull(), F.size("terms")).otherwise(
                F.greatest(F.least("least", F.size("terms")), F.lit(1))
            ),
        ),
        "stored-queries",
    )
    terms = stored.select("query_id", "least", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    wanted, size = materialise_measured(terms.select("term").distinct(), "stored-terms")
    places = documents.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(tokenise(F.col(text))).alias("place", "term")
    )
    held = materialise(
        sized_join(places, wanted, "term", size, "left_semi")
        .groupBy("doc_id", "term")
        .agg(F.collect_list("place").alias("places")),
        "held-terms",
    )
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    counted = materialise(
        lookup_join(terms, frequency, "term", "left", computed=True).withColumn(
            "df", F.coalesce("df", F.lit(0))
        ),
        "query-terms",
    )
    # A query is one text, so this window holds the terms of one text.
    rarity = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    posted = (
        counted.withColumn("_rarity", rarity)
        .filter(F.col("_rarity") <= F.col("n") - F.col("least") + 1)
        .select("query_id", "term")
    )
    met = lookup_join(held.select("doc_id", "term"), posted, "term", computed=True)
    candidates = met.select("query_id", "doc_id").distinct()
    needed = lookup_join(candidates, counted.select("query_id", "least", "term"), "query_id")
    found = (
        needed.join(held.select("doc_id", "term"), ["doc_id", "term"], "left_semi")
        .groupBy("query_id", "doc_id")
        .agg(F.count("*").cast("int").alias("n_held"), F.first("least").alias("least"))
        .filter(F.col("n_held") >= F.col("least"))
        .select("query_id", "doc_id", "n_held")
    )
    if phrase is None:
        return found
    found = materialise(found, "enough-terms")
    phrases, size = materialise_measured(
        stored.filter("in_order").select(
            "query_id", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("at", "term")
        ),
        "phrases",
    )
    # Tokens of a phrase that stand side by side begin it at one and the same place.
    begins = (
        sized_join(found, phrases, "query_id", size)
        .join(held, ["doc_id", "term"])
        .select("query_id", "doc_id", "n_held", "n_tokens", "at", F.explode("places").alias("place"))
        .groupBy("query_id", "doc_id", "n_held", "n_tokens", (F.col("place") - F.col("at")).alias("begin"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("n_tokens"))
        .select("query_id", "doc_id", "n_held")
        .distinct()
    )
    whole = stored.filter("in_order").select("query_id")
    others = lookup_join(found, whole, "query_id", "left_anti")
    return others.unionByName(begins)


def _grams(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters; none of a shorter text."""
    last = F.length(text) - size + 1
    return F.when(
        last > 0,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def match_patterns(
    values: DataFrame,
    value: str,
    patterns: DataFrame,
    pattern_id: str,
    pattern: str,
    every: bool = False,
) -> DataFrame:
    """pattern_id and value for each distinct value that a pattern matches as a whole.

    ``*`` stands for any characters, ``?`` for one.  A pattern's fixed parts are cut into pieces of
    ``GRAM`` characters, the ends of the value included, and a value meets a pattern only through
    the pattern's rarest piece, then is compared.  A pattern with shorter parts goes by
    two characters or by one; one without fixed parts meets every value, most of which it matches.
    Null matches nothing.

    Equal patterns are matched once, and equal values too.  Only the pairs found are
    multiplied by the ids that share the pattern and, with ``every``, by the rows that
    share the value; these rows are the result's own and are dealt out by their number.
    """
    text = F.col(value)
    counted_values = values.select(text.alias("value")).filter(text.isNotNull()).groupBy("value")
    distinct = materialise(counted_values.agg(F.count("*").alias("copies")), "values")
    marked = F.concat(F.lit(_BEGIN), F.col("value"), F.lit(_END))
    asked = patterns.select(F.col(pattern_id).alias("pattern_id"), F.col(pattern).alias("pattern"))
    asked = materialise(asked.filter(F.col("pattern").isNotNull()), "patterns")
    parts = F.split(F.concat(F.lit(_BEGIN), F.col("pattern"), F.lit(_END)), r"[*?]")
    longest = F.aggregate(parts, F.lit(0), lambda most, p: F.greatest(most, F.length(p)))
    # The ends alone are pieces of every value.
    sized = asked.select("pattern").distinct().withColumn("parts", parts).withColumn(
        "size", F.when(F.length(F.regexp_replace("pattern", r"[*?]", "")) == 0, 0).otherwise(F.least(longest, F.lit(GRAM)))
    )
    by_size = [
        F.when(F.col("size") == size, F.array_distinct(F.flatten(F.transform("parts", lambda p, s=size: _grams(p, s)))))
        for size in range(1, GRAM + 1)
    ]
    pieces = F.coalesce(*by_size, F.array(F.lit("")))
    grams = materialise(
        sized.select("pattern", F.explode(pieces).alias("gram")), "pattern-grams"
    )
    wanted, size = materialise_measured(grams.select("gram").distinct(), "wanted-grams")
    lengths = [row["n"] for row in wanted.select(F.length("gram").alias("n")).distinct().collect()]
    cuts = [_grams(marked, n) if n else F.array(F.lit("")) for n in sorted(lengths)] or [F.array(F.lit(""))]
    postings = materialise(
        sized_join(
            distinct.select("value", "copies", F.explode(F.array_distinct(F.concat(*cuts))).alias("gram")),
            wanted,
            "gram",
            size,
            "left_semi",
        ),
        "gram-postings",
    )
    frequency = postings.groupBy("gram").agg(F.count("*").alias("df"))
    counted = lookup_join(grams, frequency, "gram", "left", computed=True)
    rarest = first_k(
        counted.withColumn("df", F.coalesce("df", F.lit(0))), 1, "pattern", ["df", "gram"]
    ).select("pattern", "gram")
    met = lookup_join(postings, rarest, "gram", computed=True).filter(
        F.like(F.col("value"), wildcard_to_like(F.col("pattern")))
    )
    if not every:
        met = met.withColumn("copies", F.lit(1).cast("long"))
    met = materialise(met.select("pattern", "value", "copies"), "matches")
    owners = asked.groupBy("pattern").agg(F.count("*").alias("owners"))
    total = lookup_join(met, owners, "pattern", computed=True).agg(
        F.sum(F.col("owners") * F.col("copies"))
    ).first()[0]
    # A match is a small row that stands for many.
    met = met.repartition(max(1, -(-(total or 0) // RESULT_ROWS)), "value", "pattern")
    found = lookup_join(met, asked, "pattern").select("pattern_id", "value", "copies")
    if not every:
        return found.drop("copies")
    return found.select(
        "pattern_id", "value", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    ).drop("_copy")
