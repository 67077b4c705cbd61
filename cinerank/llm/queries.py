"""The operators of this package on the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.llm.alignment import Paths, aligned_tokens
from cinerank.llm.bpe import bpe_round_trip
from cinerank.llm.common import read_table
from cinerank.llm.exact_dedup import exact_duplicates
from cinerank.llm.fingerprints import fingerprints
from cinerank.llm.language import languages
from cinerank.llm.licenses import license_spans
from cinerank.llm.mixing import mix_sources
from cinerank.llm.near_dedup import near_duplicates
from cinerank.llm.ngrams import language_model_scores
from cinerank.llm.quality import quality_scores
from cinerank.llm.spelling import spelling_variants
from cinerank.llm.substrings import dedup_substrings
from cinerank.llm.suffixes import dedup_suffixes

Query = Callable[[SparkSession, str], DataFrame]


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("tk", "stands")


# translate() rather than lower(): only A-Z change.
EXACT_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return quality_scores(read_table(spark, sf_dir, "documents"), labels)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(
        "intervals", F.lit(0).cast("long"), lambda total, run: total + run[1] - run[0]
    )
    return dedup_substrings(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Windows are compared as their words joined by one blank.
SUBSTRING_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
w AS (
    SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
    FROM w JOIN f USING (h) WHERE doc_id > first),
o AS (
    SELECT doc_id, i, words[i] AS word
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
k AS (
    SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
    FROM o ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, run: total + run[1] - run[0])
    return dedup_suffixes(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2).drop("tk", "stands")


NEAR_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
    SELECT u, v FROM c JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id
    WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (
    SELECT doc_id AS u, doc_id AS v FROM documents
    UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
k AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT k.doc_id, coalesce(n, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept
FROM k LEFT JOIN n USING (doc_id)
"""

def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(read_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = Paths(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return aligned_tokens(read_table(spark, sf_dir, "documents"), paths)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda span: span["exact"])
    found = license_spans(read_table(spark, sf_dir, "documents")).withColumn("base", base)

    def labels(spans: str):
        return F.array_join(F.array_sort(F.array_distinct(F.col(f"{spans}.label"))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op11_alignment": op11_alignment,
    "op12_licenses": op12_licenses,
    "op13_spelling": op13_spelling,
    "op8_lm_scoring": op8_lm_scoring,
    "op7_near_dedup": op7_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op1_bpe": op1_bpe,
    "op3_quality": op3_quality,
    "op9_language": op9_language,
    "op6_mixing": op6_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op10_fingerprints": op10_fingerprints,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_SQL,
    "op5_exact_dedup": EXACT_SQL,
    "op7_near_dedup": NEAR_SQL,
}
