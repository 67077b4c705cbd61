"""Ranked text search for batches of queries.

A query matches a document when they share a term.  Each field is scored by
BM25 (Robertson and Zaragoza 2009) with idf = ln(1 + (N - df + 0.5)/(df + 0.5)),
k1 = 1.2 and b = 0.75; with several fields the best one counts.  Equal scores
go to the smaller document id.

Joins against a side that is usually small are sized before they are planned.
Joins of two large sides are left to adaptive execution, which also splits a
hot key on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinerank.functions.text import tokenise
from cinerank.operators.skew import (
    BROADCAST_LIMIT,
    lookup_join,
    materialise_measured,
    measured_bytes,
    sized_join,
)
from cinerank.operators.topk import as_ranked_list, first_k, top_k
from cinerank.session import materialise, spread

K1 = 1.2
B = 0.75
PAGE = 10
LEVELS = 16
DECIMALS = 6
# Scores are compared after rounding, so bounds give way by more than one step.
SLACK = 2e-6


@dataclass(frozen=True)
class TextIndex:
    """``postings``: field, term, text_id, weight, level; ``terms``: field, term, df, idf,
    ceiling; ``members``: field, text_id, doc_id.

    Documents with the same text in a field share one entry, named by the
    smallest of their ids, so scoring does not grow with repeated titles or
    genre lists.  ``weight`` is what one occurrence of the term in a query adds
    to the score; ``level`` places it in ``LEVELS`` equal steps up to the term's
    largest weight, the ``ceiling``.
    """

    postings: DataFrame
    terms: DataFrame
    members: DataFrame


def token_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per token: doc_id, position from 0, term."""
    return spread(docs.select(doc_id, text), doc_id).select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(tokenise(F.col(text))).alias("position", "term"),
    )


def _by_field(
    docs: DataFrame, doc_id: str, fields: Sequence[str], **values: Callable[[Column], Column]
) -> DataFrame:
    """One row per document and field with the given values of the field, from one scan."""
    entries = [
        F.struct(F.lit(f).alias("field"), *[v(F.col(f)).alias(name) for name, v in values.items()])
        for f in fields
    ]
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.array(*entries)).alias("_entry")
    ).select("doc_id", "_entry.*")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _tokens_or_none(text: Column) -> Column:
    """Tokens; a missing text has none."""
    return F.coalesce(tokenise(text), F.expr("array()"))


def field_tokens(docs: DataFrame, doc_id: str, fields: Sequence[str]) -> DataFrame:
    """doc_id, field, text_key, terms."""
    return _by_field(docs, doc_id, fields, text_key=_text_key, terms=_tokens_or_none)


def field_statistics(docs: DataFrame, doc_id: str, fields: Sequence[str]) -> DataFrame:
    """Documents and mean length per field: as many rows as there are fields."""
    lengths = _by_field(docs, doc_id, fields, length=lambda text: F.size(_tokens_or_none(text)))
    return lengths.groupBy("field").agg(
        F.count("*").alias("n_docs"), F.avg("length").alias("mean_length")
    )


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs.cast("double") - df + 0.5) / (df + 0.5))


def document_frequencies(docs: DataFrame, doc_id: str, field: str) -> DataFrame:
    """term, df, idf of one field: each document's terms once, counted before the shuffle."""
    terms = spread(docs.select(doc_id, field), doc_id).select(
        F.explode(F.array_distinct(_tokens_or_none(F.col(field)))).alias("term")
    )
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = inverse_document_frequency(F.lit(docs.count()), F.col("df"))
    return counted.withColumn("idf", idf)


def build_index(
    docs: DataFrame, doc_id: str, fields: Sequence[str], only: DataFrame | None = None
) -> TextIndex:
    """Index whole documents.  ``only`` (term) limits the postings, not the statistics.

    Tokens are counted per text before the shuffle, and a count covers all
    documents with that text; dividing by their number gives the frequency in
    one.
    """
    # Read several times; made and dealt out once, also where its size is not known.
    docs = materialise(spread(docs.select(doc_id, *fields), doc_id), "docs")
    tokens = field_tokens(docs, doc_id, fields)
    keyed = _by_field(docs, doc_id, fields, text_key=_text_key)
    key = ["field", "text_key"]
    texts, texts_size = materialise_measured(
        keyed.groupBy(*key).agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")),
        "texts",
    )
    members = sized_join(keyed, texts.drop("copies"), key, texts_size).select(
        "field", "text_id", "doc_id"
    )
    rows = tokens.select(
        "field", "text_key", F.size("terms").alias("length"), F.explode("terms").alias("term")
    )
    if only is not None:
        rows = lookup_join(rows, only.select("term").distinct(), "term", "left_semi", computed=True)
    counted = rows.groupBy("field", "term", "text_key", "length").agg(F.count("*").alias("n"))
    tf = F.col("n") / F.col("copies")
    length = 1 - B + B * F.col("length") / F.col("mean_length")
    counts = materialise(
        sized_join(counted, texts, key, texts_size)
        .join(F.broadcast(field_statistics(docs, doc_id, fields)), "field")  # one row per field
        .select(
            "field",
            "term",
            "text_id",
            "copies",
            "n_docs",
            (tf * (K1 + 1) / (tf + K1 * length)).alias("saturated"),
        ),
        "term-counts",
    )
    idf = inverse_document_frequency(F.col("n_docs"), F.col("df"))
    terms, size = materialise_measured(
        counts.groupBy("field", "term")
        .agg(
            F.sum("copies").alias("df"),
            F.max("n_docs").alias("n_docs"),
            F.max("saturated").alias("highest"),
        )
        .select("field", "term", "df", idf.alias("idf"), "highest")
        .withColumn("ceiling", F.col("idf") * F.col("highest"))
        .drop("highest"),
        "terms",
    )
    weight = F.col("idf") * F.col("saturated")
    # A search reads the postings several times, so they are written too.
    postings = materialise(
        sized_join(
            counts, terms.select("field", "term", "idf", "ceiling"), ["field", "term"], size
        ).select(
            "field",
            "term",
            "text_id",
            weight.alias("weight"),
            level_of(weight, F.col("ceiling")).alias("level"),
        ),
        "postings",
    )
    return TextIndex(postings, terms, members)


def level_of(weight: Column, ceiling: Column) -> Column:
    step = F.floor(weight / ceiling * LEVELS)
    return F.greatest(F.least(step, F.lit(LEVELS - 1)), F.lit(0)).cast("int")


def write_index(index: TextIndex, path: str) -> None:
    """Store the index with postings ordered by term, so that a term reads few row groups.

    The range key includes the text, so a frequent term fills many files.
    """
    keys = ["term", "text_id"]
    ordered = index.postings.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    keys = ["text_id", "doc_id"]
    grouped = index.members.repartitionByRange(*keys).sortWithinPartitions(*keys)
    grouped.write.mode("overwrite").parquet(f"{path}/members")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(
        *[spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "members")]
    )


def _keyed_texts(requests: DataFrame, query: str) -> DataFrame:
    """Distinct query texts under a 16-byte key; only the key travels with scores."""
    text = F.col(query)
    return (
        requests.select(_text_key(text).alias("query_id"), text.alias("query"))
        .filter(F.col("query_id").isNotNull())
        .dropDuplicates(["query_id"])
    )


def known_texts(requests: DataFrame, query: str, index: TextIndex) -> DataFrame:
    """The distinct texts that share a term with the index: no other has a hit.

    Texts without such a term are left out where they are read, before texts are made
    distinct, as long as the terms are few enough for a broadcast.
    """
    known = index.terms.select("term").distinct()
    if measured_bytes(known) > BROADCAST_LIMIT:
        return requests.select(query).distinct()
    terms = requests.select(query, F.explode(tokenise(F.col(query))).alias("term"))
    return terms.join(F.broadcast(known), "term", "left_semi").select(query).distinct()


def query_term_rows(requests: DataFrame, query: str) -> DataFrame:
    """query_id, term, qtf: the distinct terms of each distinct text and their frequency."""
    return (
        _keyed_texts(requests, query)
        .select("query_id", F.explode(tokenise(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _count_from(counts: Column, weight: Column, ceiling: Column) -> Column:
    """Postings of a term at or above the level of ``weight``; none beyond the ceiling."""
    upper = F.slice(counts, level_of(weight, ceiling) + 1, LEVELS)
    number = F.aggregate(upper, F.lit(0).cast("long"), lambda total, n: total + n)
    return F.when(weight <= ceiling, number).otherwise(0)


def _requirements(
    query_terms: DataFrame, postings: DataFrame, terms: DataFrame, k: int, favour: float
) -> DataFrame:
    """For each query, field and term: the least weight a useful posting has.

    A term with ``k`` postings of weight w or more proves that ``k`` documents
    score at least w, so the best such w over the query's terms is a floor for
    the result.  There are two ways to use it, and each query takes, per field,
    the one that touches fewer rows:

    ``direct``: all terms are added up.  A document that reaches the floor has
    no posting weaker than the floor less the ceilings of all other terms.

    Otherwise: terms are taken by falling ceiling, and a document is proposed
    by the first term it has.  It reaches the floor only if that posting is no
    weaker than the floor less the ceilings of the later terms.  Frequent terms
    come last and propose next to nothing; proposals are scored one by one.
    """
    best = first_k(postings, k, ["field", "term"], [F.desc("weight"), "text_id"], "_place")
    kth = best.groupBy("field", "term").agg(
        F.when(F.count("*") >= k, F.min("weight")).alias("kth")
    )
    at_level = [F.count(F.when(F.col("level") == i, 1)) for i in range(LEVELS)]
    levels = postings.groupBy("field", "term").agg(F.array(*at_level).alias("counts"))
    figures = (
        terms.select("field", "term", "ceiling")
        .join(kth, ["field", "term"])
        .join(levels, ["field", "term"])
    )
    # A query is one text, so these windows hold the terms of one text.
    per_query = Window.partitionBy("query_id")
    per_field = Window.partitionBy("query_id", "field")
    later = per_field.orderBy(F.desc("highest"), "term").rowsBetween(1, Window.unboundedFollowing)
    floor = F.coalesce("floor", F.lit(0.0)) - SLACK
    ceiling, counts = F.col("ceiling"), F.col("counts")
    return (
        query_terms.join(figures, "term")
        .withColumn("highest", F.col("qtf") * ceiling)
        .withColumn("floor", F.max(F.col("qtf") * F.col("kth")).over(per_query))
        .withColumn("others", F.sum("highest").over(per_field) - F.col("highest"))
        .withColumn("later", F.coalesce(F.sum("highest").over(later), F.lit(0.0)))
        .withColumn("need", F.greatest((floor - F.col("others")) / F.col("qtf"), F.lit(0.0)))
        .withColumn("need_first", F.greatest((floor - F.col("later")) / F.col("qtf"), F.lit(0.0)))
        .withColumn("added", F.sum(_count_from(counts, F.col("need"), ceiling)).over(per_field))
        .withColumn(
            "proposed", F.sum(_count_from(counts, F.col("need_first"), ceiling)).over(per_field)
        )
        .withColumn("n_terms", F.count("*").over(per_field))
        .withColumn(
            "direct", F.col("added") <= F.lit(favour) * F.col("proposed") * (F.col("n_terms") + 1)
        )
        .select(
            "query_id",
            "field",
            "term",
            "qtf",
            "ceiling",
            "direct",
            F.when(F.col("direct"), F.col("need")).otherwise(F.col("need_first")).alias("need"),
        )
    )


def _best_documents(
    requests: DataFrame, query: str, index: TextIndex, k: int, favour: float = 1.0
) -> DataFrame:
    """Best ``k`` documents of each distinct query text: query_id, doc_id, score, rank.

    Queries meet postings on (field, term, level) and ask only for the levels
    that can matter to them, so a term found everywhere is not paired with
    every query that holds it.  The best ``k`` texts of each field then stand
    for their documents: a document outside them has ``k`` others before it.
    ``favour`` weighs the two ways of ``_requirements``: below 1 prefers proposals.
    """
    rows = query_term_rows(requests, query)
    known = index.terms.select("term").distinct()
    if measured_bytes(known) <= BROADCAST_LIMIT:
        # A term that no document has adds nothing to a score.
        rows = rows.join(F.broadcast(known), "term", "left_semi")
    query_terms, size = materialise_measured(rows, "query-terms")
    wanted = query_terms.select("term").distinct()
    postings = sized_join(index.postings, wanted, "term", size, "left_semi")
    needs, size = materialise_measured(
        _requirements(query_terms, postings, index.terms, k, favour), "requirements"
    )
    lowest = level_of(F.col("need"), F.col("ceiling"))
    asked = needs.filter(F.col("need") <= F.col("ceiling")).select(
        "query_id",
        "field",
        "term",
        "qtf",
        "need",
        "direct",
        F.explode(F.sequence(lowest, F.lit(LEVELS - 1))).alias("level"),
    )
    matched = sized_join(postings, asked, ["field", "term", "level"], size * LEVELS).filter(
        F.col("weight") >= F.col("need")
    )
    entry = ["query_id", "field", "text_id"]
    added = matched.filter("direct").select(*entry, "qtf", "weight")
    proposals = matched.filter(~F.col("direct")).select(*entry).distinct()
    looked_up = (
        proposals.join(needs.select("query_id", "field", "term", "qtf"), ["query_id", "field"])
        .join(postings.select("field", "term", "text_id", "weight"), ["field", "term", "text_id"])
        .select(*entry, "qtf", "weight")
    )
    scored = (
        added.unionByName(looked_up)
        .groupBy(*entry)
        .agg(F.round(F.sum(F.col("qtf") * F.col("weight")), DECIMALS).alias("score"))
    )
    texts, size = materialise_measured(
        top_k(scored, k, ["query_id", "field"], "score", "text_id"), "best-texts"
    )
    hit = texts.select("field", "text_id").distinct()
    holders = sized_join(index.members, hit, ["field", "text_id"], size, "left_semi")
    # Of each text the k smallest document ids can be needed, and no more.
    first = (
        first_k(holders, k, ["field", "text_id"], ["doc_id"], "_place")
        .groupBy("field", "text_id")
        .agg(F.collect_list("doc_id").alias("_docs"))
    )
    documents = (
        texts.join(first, ["field", "text_id"])
        .select("query_id", "score", F.explode("_docs").alias("doc_id"))
        .groupBy("query_id", "doc_id")
        .agg(F.max("score").alias("score"))
    )
    return top_k(documents, k, "query_id", "score", "doc_id")


def search_texts(
    requests: DataFrame, query: str, index: TextIndex, k: int = PAGE, favour: float = 1.0
) -> DataFrame:
    """Best ``k`` documents of each distinct query text: query, doc_id, score, rank."""
    hits = _best_documents(requests, query, index, k, favour)
    return hits.join(_keyed_texts(requests, query), "query_id").select(
        "query", "doc_id", "score", "rank"
    )


def search(
    requests: DataFrame,
    request_id: str,
    query: str,
    index: TextIndex,
    k: int = PAGE,
    details: DataFrame | None = None,
) -> DataFrame:
    """Hits of every request: request_id, query, doc_id, score, rank.  No match, no row.

    Equal texts are searched once, and a popular text is joined back as one
    list, so it costs no more to score than a rare one.  ``details`` (doc_id and others)
    are looked up for the hits of each text and not again for each request; their
    columns follow.
    """
    hits = _best_documents(requests, query, index, k).withColumn("place", F.col("rank"))
    fields = ["doc_id", "score", "place"]
    if details is not None:
        hits, size = materialise_measured(hits, "hits")
        known = sized_join(details, hits.select("doc_id").distinct(), "doc_id", size, "left_semi")
        hits = hits.join(known, "doc_id")
        fields += [c for c in details.columns if c != "doc_id"]
    # Measured, as a plan does not tell that a list has many entries.
    lists, size = materialise_measured(as_ranked_list(hits, "query_id", fields, "hits"), "hit-lists")
    text = F.col(query)
    asked = requests.select(
        F.col(request_id), text.alias("query"), _text_key(text).alias("query_id")
    )
    return (
        sized_join(asked, lists, "query_id", size)
        .select(request_id, "query", F.explode("hits").alias("_hit"))
        .select(request_id, "query", *[f"_hit.{name}" for name in fields])
        .withColumnRenamed("place", "rank")
    )


def first_hit(requests: DataFrame, request_id: str, query: str, index: TextIndex) -> DataFrame:
    """The best document of each request that has one."""
    return search(requests, request_id, query, index, 1).drop("rank")
