"""The corpus pipeline: stages over ``documents``, each written and read again.

A row is joined to what was decided about it by its doc_id and a hash of its text,
so null and repeated ids go through like any other; other columns, whatever they are
called, stay as they are.  Decisions are small rows; texts are not shuffled for them
while those that change something fit a broadcast.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.llm.bpe import encode
from cinerank.llm.common import id_key, read_table, text_key
from cinerank.llm.exact_dedup import exact_duplicates
from cinerank.llm.mixing import doc_mark, mix_sources
from cinerank.llm.near_dedup import near_duplicates
from cinerank.llm.quality import ACCEPT, fit
from cinerank.llm.queries import tokenizer_path
from cinerank.operators.skew import lookup_join
from cinerank.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Rows that go to a Python worker together.  Rows hold whole texts here, and Spark bounds
# a batch by its rows: ten thousand, unless the session says otherwise.
BATCH_ROWS = 500
# Blocks of the last stage: workers of five stages share an executor's memory.
BPE_BLOCK_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_DEFAULT = 10_000


def _small_batches(stage: Stage) -> Stage:
    """A stage whose texts go to Python in small batches; a session's own setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # The setting is read when the stage's result is written, so it is left in place.
        if int(spark.conf.get(_BATCH_CONF)) == _BATCH_DEFAULT:
            spark.conf.set(_BATCH_CONF, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def _new_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``docs`` has."""
    taken = {name.lower() for name in docs.columns}
    free = []
    for name in wanted:
        while name in taken:
            name += "_"
        free.append(name)
    return free


def _only_standing(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose decision is ``stands``; of rows alike in id and text, one.

    Of such rows the one with the smallest hash over all columns stays, so that reruns agree.
    """
    did, tk, stands, several = _new_names(docs, "did", "tk", "stands", "several")
    # Most documents stand alone, and need no row here.
    known = (
        decided.groupBy(id_key().alias(did), F.col("tk").alias(tk))
        .agg(F.max("stands").alias(stands), (F.count("*") > 1).alias(several))
        .filter(~F.col(stands) | F.col(several))
    )
    named = docs.withColumns({did: id_key(), tk: text_key()})
    marked = lookup_join(named, known, [did, tk], "left", computed=True).filter(
        F.coalesce(stands, F.lit(True))
    )
    alone = marked.filter(~F.coalesce(several, F.lit(False))).select(*docs.columns)
    columns = [F.col(f"`{name}`") for name in docs.columns]
    row = _new_names(docs, "row")[0]
    repeated = (
        marked.filter(several)
        .groupBy(did, tk)
        .agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row))
        .select(f"{row}.*")
    )
    return alone.unionByName(repeated)


@_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(model.scorer(F.col("text")) >= ACCEPT)


@_small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the one with the largest doc_id."""
    return _only_standing(docs, exact_duplicates(docs))


@_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates, the one with the smallest doc_id."""
    return _only_standing(docs, near_duplicates(docs))


@_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    did, mark, copies, copy = _new_names(docs, "did", "mark", "copies", "copy")
    taken = (
        mix_sources(docs)
        .groupBy(id_key().alias(did), F.col("mark").alias(mark))
        .agg(F.max("copies").alias(copies))
        .filter(F.col(copies) > 0)
    )
    named = docs.withColumns({did: id_key(), mark: doc_mark()})
    return (
        lookup_join(named, taken, [did, mark], computed=True)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*docs.columns)
    )


@_small_batches
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the text they decode to."""
    return encode(docs, tokenizer_path(), decoded=True, block_bytes=BPE_BLOCK_BYTES).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]
# Neither a learned classifier nor a tokenizer can be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
