"""A stored search index that grows and shrinks by segments.

A segment holds the terms of the documents of one change, counted once.  Removing
documents writes a segment too, one that takes their share off the figures: how many
documents there are, how long they are, and how many hold a term.  Those figures are
sums over segments, so a query reads sums for its own terms and the postings of its own
terms, and no document is tokenised again.  Versions are snapshots: a reader sees all
of a change or nothing of it.

Layout of a segment, each part a table:

* ``counts``: field, term, text_key, n, length: a term of a text, each text once
* ``members``: field, text_key, doc_id, sign: which documents have a text, or had it
* ``terms``: field, term, df, may be negative
* ``figures``: field, n_docs, total_length, may be negative
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.operators.search import (
    B,
    K1,
    TextIndex,
    field_tokens,
    inverse_document_frequency,
    level_of,
)
from cinerank.operators.skew import lookup_join, materialise_measured, sized_join
from cinerank.session import materialise, spread
from cinerank.sinks.snapshots import Snapshot, commit, current, fresh_part

KEY = ["field", "text_key"]
_COUNTS = "field string, term string, text_key binary, n long, length int"
_TERMS = "field string, term string, df long"
_FIGURES = "field string, n_docs long, total_length long"


def _members(kind: str) -> str:
    return f"field string, text_key binary, doc_id {kind}, sign int"


def _read(spark: SparkSession, path: str, found: Snapshot, table: str, schema: str) -> DataFrame:
    places = [f"{path}/{part}/{table}" for part in found.parts]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def _id_type(spark: SparkSession, path: str, found: Snapshot) -> str:
    if not found.parts:
        return "long"
    stored = spark.read.parquet(f"{path}/{found.parts[0]}/members")
    return stored.schema["doc_id"].dataType.simpleString()


def _live_members(members: DataFrame) -> DataFrame:
    """Documents that were added and not removed since: adding counts one, removing minus one."""
    live = members.groupBy("field", "text_key", "doc_id").agg(F.sum("sign").alias("_live"))
    return live.filter(F.col("_live") > 0).drop("_live")


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of ``keys``, so that a lookup by them reads few row groups."""
    stored = materialise(rows, "segment")
    return stored.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _write_segment(
    path: str, part: str, counts: DataFrame, members: DataFrame, terms: DataFrame, figures: DataFrame
) -> None:
    _ordered(counts, "term", "text_key").write.parquet(f"{path}/{part}/counts")
    _ordered(members, "text_key", "doc_id").write.parquet(f"{path}/{part}/members")
    _ordered(terms, "term", "field").write.parquet(f"{path}/{part}/terms")
    figures.coalesce(1).write.parquet(f"{path}/{part}/figures")


def _removal(
    spark: SparkSession, path: str, found: Snapshot, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """members, terms and figures that take the given live documents off; None if none is live.

    ``ids`` has doc_id.
    """
    kind = _id_type(spark, path, found)
    wanted = ids.select(F.col("doc_id").cast(kind)).distinct()
    stored = _read(spark, path, found, "members", _members(kind))
    gone = materialise(
        _live_members(lookup_join(stored, wanted, "doc_id", "left_semi", computed=True)), "removed"
    )
    if gone.isEmpty():
        return None
    copies, size = materialise_measured(
        gone.groupBy(*KEY).agg(F.count("*").alias("copies")), "removed-texts"
    )
    counts = _read(spark, path, found, "counts", _COUNTS).dropDuplicates([*KEY, "term"])
    held = sized_join(counts, copies, KEY, size)
    terms = held.groupBy("field", "term").agg((-F.sum("copies")).alias("df"))
    lengths = held.groupBy(*KEY).agg((F.first("length") * F.first("copies")).alias("length"))
    totals = lengths.groupBy("field").agg(F.sum("length").alias("total_length"))
    figures = (
        gone.groupBy("field")
        .agg((-F.count("*")).alias("n_docs"))
        .join(totals, "field", "left")
        .select("field", "n_docs", (-F.coalesce("total_length", F.lit(0))).alias("total_length"))
    )
    return gone.withColumn("sign", F.lit(-1)), terms, figures


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def remove_documents(spark: SparkSession, path: str, ids: DataFrame) -> Snapshot:
    """Take the documents of ``ids`` (doc_id) out; unknown ids are passed over."""
    found = current(spark, path)
    removal = _removal(spark, path, found, ids)
    if removal is None:
        return found
    part = fresh_part("removed")
    members, terms, figures = removal
    _write_segment(path, part, _empty(spark, _COUNTS), members, terms, figures)
    return commit(spark, path, found, [*found.parts, part])


def add_documents(docs: DataFrame, doc_id: str, fields: Sequence[str], path: str) -> Snapshot:
    """Index documents; one that is there already is replaced.

    Each doc_id occurs once in ``docs``.  All segments of an index have the same fields.
    """
    spark = docs.sparkSession
    found = current(spark, path)
    docs = spread(docs.select(doc_id, *fields), doc_id)
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    removal = _removal(spark, path, found, ids) if found.parts else None
    tokens = field_tokens(docs, doc_id, fields)
    length = F.size("terms").alias("length")
    # Each text is counted once, however many documents have it.
    texts = materialise(
        tokens.select("field", "text_key", "doc_id", length, "terms"), "segment-tokens"
    )
    counts = (
        texts.dropDuplicates(KEY)
        .select("field", "text_key", "length", F.explode("terms").alias("term"))
        .groupBy("field", "term", "text_key", "length")
        .agg(F.count("*").alias("n"))
        .select("field", "term", "text_key", "n", "length")
    )
    members = texts.select("field", "text_key", "doc_id", F.lit(1).alias("sign"))
    terms = (
        texts.select("field", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("field", "term")
        .agg(F.count("*").alias("df"))
    )
    figures = texts.groupBy("field").agg(
        F.count("*").alias("n_docs"), F.sum("length").cast("long").alias("total_length")
    )
    part = fresh_part("added")
    if removal is not None:
        members = members.unionByName(removal[0])
        terms, figures = terms.unionByName(removal[1]), figures.unionByName(removal[2])
    _write_segment(path, part, counts, members, terms, figures)
    return commit(spark, path, found, [*found.parts, part])


def compact(spark: SparkSession, path: str) -> Snapshot:
    """Merge all segments into one, without what was removed; nothing is tokenised again."""
    found = current(spark, path)
    kind = _id_type(spark, path, found)
    members = materialise(
        _live_members(_read(spark, path, found, "members", _members(kind))), "live-members"
    )
    live = members.select(*KEY).distinct()
    counts = _read(spark, path, found, "counts", _COUNTS).dropDuplicates([*KEY, "term"])
    part = fresh_part("merged")
    _write_segment(
        path,
        part,
        counts.join(live, KEY, "left_semi"),
        members.withColumn("sign", F.lit(1)),
        _document_frequencies(_read(spark, path, found, "terms", _TERMS)),
        _figures(_read(spark, path, found, "figures", _FIGURES)),
    )
    return commit(spark, path, found, [part])


def _document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("field", "term").agg(F.sum("df").alias("df")).filter(F.col("df") > 0)


def _figures(figures: DataFrame) -> DataFrame:
    """One row per field."""
    return figures.groupBy("field").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total_length")
    )


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """field, term, df, idf of the whole index: one sum per term, no postings are read."""
    found = current(spark, path)
    figures = _figures(_read(spark, path, found, "figures", _FIGURES))
    idf = inverse_document_frequency(F.col("n_docs"), F.col("df"))
    return (
        _document_frequencies(_read(spark, path, found, "terms", _TERMS))
        .join(F.broadcast(figures), "field")  # one row per field
        .select("field", "term", "df", idf.alias("idf"))
    )


def open_index(
    spark: SparkSession, path: str, only: DataFrame | None = None, version: Snapshot | None = None
) -> TextIndex:
    """The index as it stands, for searches.  ``only`` (term): the terms that will be asked for.

    Equal to an index built from the documents that are live.  Postings are read by term,
    members by the texts that hold one of the terms.
    """
    found = version or current(spark, path)
    kind = _id_type(spark, path, found)
    counts = _read(spark, path, found, "counts", _COUNTS)
    terms = _read(spark, path, found, "terms", _TERMS)
    members = _read(spark, path, found, "members", _members(kind))
    if only is not None:
        wanted, size = materialise_measured(only.select("term").distinct(), "wanted-terms")
        counts = sized_join(counts, wanted, "term", size, "left_semi")
        terms = sized_join(terms, wanted, "term", size, "left_semi")
    # A text that is in several segments was counted in each.
    counts = materialise(counts.dropDuplicates([*KEY, "term"]), "segment-counts")
    if only is not None:
        held = counts.select(*KEY).distinct()
        members = lookup_join(members, held, KEY, "left_semi", computed=True)
    members = materialise(_live_members(members), "live-members")
    texts, size = materialise_measured(
        members.groupBy(*KEY).agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")),
        "texts",
    )
    named = sized_join(members, texts.drop("copies"), KEY, size).select("field", "text_id", "doc_id")
    figures = _figures(_read(spark, path, found, "figures", _FIGURES))
    mean = (F.col("total_length") / F.col("n_docs")).alias("mean_length")
    idf = inverse_document_frequency(F.col("n_docs"), F.col("df"))
    known, known_size = materialise_measured(
        _document_frequencies(terms)
        .join(F.broadcast(figures), "field")  # one row per field
        .select("field", "term", "df", idf.alias("idf"), mean),
        "known-terms",
    )
    weighted = materialise(
        sized_join(sized_join(counts, texts, KEY, size), known, ["field", "term"], known_size).select(
            "field", "term", "text_id", "df", "idf", (F.col("idf") * _saturated()).alias("weight")
        ),
        "weighted",
    )
    ceilings = weighted.groupBy("field", "term").agg(
        F.first("df").alias("df"), F.first("idf").alias("idf"), F.max("weight").alias("ceiling")
    )
    ceilings, size = materialise_measured(ceilings, "terms")
    postings = materialise(
        sized_join(
            weighted.drop("df", "idf"), ceilings.select("field", "term", "ceiling"), ["field", "term"], size
        ).select(
            "field", "term", "text_id", "weight", level_of(F.col("weight"), F.col("ceiling")).alias("level")
        ),
        "postings",
    )
    return TextIndex(postings, ceilings, named)


def _saturated() -> Column:
    tf = F.col("n").cast("double")
    length = 1 - B + B * F.col("length") / F.col("mean_length")
    return tf * (K1 + 1) / (tf + K1 * length)
