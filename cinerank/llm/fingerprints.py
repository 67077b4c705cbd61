"""Order-independent fingerprints: sums of wide vectors hashed from paragraphs.

A text is cut into paragraphs: runs of up to ``PARAGRAPH_WORDS`` words within a
line.  Each paragraph is hashed to a vector, and the fingerprint is the sum of
the vectors, so paragraphs can be added to or taken from a fingerprint without
their text, in any order.  A fingerprint has two parts:

* ``EQUAL_LANES`` components of 32 bits, summed modulo 2^32: equal multisets of
  paragraphs have equal sums, others differ but for a chance of about 2^-256;
* ``LIKE_LANES`` components of +1 or -1, summed modulo 2^16: the squared distance
  of two such sums estimates how many paragraphs the texts do not share.

Only DataFrame functions are used.  Texts are shuffled once, by ranges of doc_id;
neighbours, sums and likeness are then found inside each range without a further
shuffle.  Splits of the ranges come from quantiles of the ids, so ids may be
distributed in any way.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import keyed, parts_for, real_id, text_bytes

PARAGRAPH_WORDS = 4
EQUAL_LANES = 8
LIKE_LANES = 128
RANGE_BYTES = 4 << 20
MOST_RANGES = 10_000
_WORD32 = (1 << 32) - 1
_PAIR = (1 << 32) + 1


def paragraphs(text: Column, words: int = PARAGRAPH_WORDS) -> Column:
    """Runs of up to ``words`` words; a line break ends a run."""
    pattern = rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{words}}}"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda run: F.rtrim(F.translate(run, "\t\v\f\r", "    ")),
    )


def lane_sums(paragraph: Column) -> list[Column]:
    """Aggregates over paragraphs; null adds nothing.

    A long holds two counters of sign bits, which bounds a text to 2^31 paragraphs.
    """

    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), paragraph)

    def total(value: Column, name: str) -> Column:
        return F.sum(F.when(paragraph.isNotNull(), value).otherwise(F.lit(0))).alias(name)

    sums = [F.count(paragraph).alias("n")]
    for i in range(EQUAL_LANES // 2):
        sums.append(total(hashed(i).bitwiseAND(F.lit(_WORD32)), f"e{2 * i}"))
        sums.append(total(F.shiftrightunsigned(hashed(i), 32), f"e{2 * i + 1}"))
    for i in range(LIKE_LANES // 2):
        bits = F.shiftrightunsigned(hashed(100 + i // 32), i % 32)
        sums.append(total(bits.bitwiseAND(F.lit(_PAIR)), f"s{i}"))
    return sums


def lanes() -> list[Column]:
    """The aggregates of ``lane_sums`` as two arrays, each component modulo its power."""
    equal = F.array(*[F.col(f"e{i}").bitwiseAND(F.lit(_WORD32)) for i in range(EQUAL_LANES)])
    ones = F.array(
        *[
            half
            for i in range(LIKE_LANES // 2)
            for half in (F.col(f"s{i}").bitwiseAND(F.lit(_WORD32)), F.shiftrightunsigned(f"s{i}", 32))
        ]
    )
    signs = F.transform(ones, lambda x: F.pmod(x * 2 - F.col("n"), F.lit(1 << 16)))
    return [equal.alias("equal"), signs.alias("signs")]


def as_text(equal: Column, signs: Column) -> Column:
    def digits(values: Column, width: int) -> Column:
        padded = F.transform(values, lambda x: F.lower(F.lpad(F.hex(x), width, "0")))
        return F.array_join(padded, "")

    return F.concat(digits(equal, 8), digits(signs, 4))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal sums, about the share of common paragraphs else, 0 at least.

    ``a`` and ``b`` are sign sums modulo 2^16, read as the nearest to zero.
    """

    def centred(x: Column) -> Column:
        return F.pmod(x + (1 << 15), F.lit(1 << 16)) - (1 << 15)

    def squares(values: Column) -> Column:
        return F.aggregate(
            values, F.lit(0).cast("long"), lambda total, x: total + centred(x) * centred(x)
        )

    apart = squares(F.zip_with(a, b, lambda x, y: x - y))
    whole = squares(a) + squares(b)
    return F.when(whole == 0, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - apart.cast("double") / whole)
    )


def _ranged(rows: DataFrame) -> DataFrame:
    """Adds ``range``: consecutive ids share one, and ranges are about equally large."""
    n, size = text_bytes(rows)
    count = min(parts_for(size, RANGE_BYTES), MOST_RANGES, max(1, n))
    probabilities = [i / count for i in range(1, count)]
    inner = (
        rows.select(F.col("did").cast("double")).approxQuantile("did", probabilities, 0.2 / count)
        if probabilities and n
        else []
    )
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    if len(splits) == 2:
        return rows.withColumn("range", F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="range")
    return (
        cut.transform(rows.withColumn("place", F.col("did").cast("double")))
        .drop("place")
        .withColumn("range", F.col("range").cast("int"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text that follows in ascending doc_id; the last has the first's.

    Columns: range, row (unique within range), did, text, following, and border: the
    following text where it belongs to another range, else null.
    """
    rows = _ranged(keyed(docs))
    heads = rows.groupBy("range").agg(F.min(F.struct("did", "tk")).alias("head"))
    # One row per range, of which there are at most MOST_RANGES.
    after = Window.orderBy("range")
    whole = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = heads.select(
        F.col("range").alias("before"),
        F.coalesce(F.lead("head").over(after), F.first("head").over(whole)).alias("head"),
    ).select("before", "head.did", "head.tk")
    borders = (
        rows.join(F.broadcast(wanted), ["did", "tk"])
        .groupBy("before")
        .agg(F.first("text").alias("border"))
        .withColumnRenamed("before", "range")
    )
    order = Window.partitionBy("range").orderBy("did", "tk")
    return (
        rows.select(
            "range",
            "did",
            "text",
            F.row_number().over(order).alias("row"),
            F.lead("text").over(order).alias("inside"),
        )
        .join(borders, "range", "left")
        .select(
            "range",
            "row",
            "did",
            "text",
            F.coalesce("inside", "border").alias("following"),
            F.when(F.col("inside").isNull(), F.col("border")).alias("border"),
        )
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document instead of its own
    second half.  A null text is empty, and the fingerprint of no paragraphs is all
    zeros; two such fingerprints have likeness 1.  A null doc_id comes first in the
    order; rows with equal ids are ordered by a hash of their text.  Texts that
    differ in white space only, or in the order of paragraphs, may share a
    fingerprint; equal texts always do.  A single document is its own next one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    versions = with_next(docs).withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - half),
            F.substring("following", F.lit(1), half),
        ),
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")),
        F.struct(F.lit(2).alias("kind"), F.col("border").alias("body")),
    )
    pieces = (
        versions.select(
            "range",
            "row",
            "did",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.explode(F.filter(kinds, lambda x: x["body"].isNotNull())).alias("version"),
        )
        .select("*", F.explode_outer(paragraphs(F.col("version.body"))).alias("paragraph"))
        .withColumn("kind", F.col("version.kind"))
    )
    # Rows already lie by range, so grouping by range and more needs no shuffle.
    sums = (
        pieces.groupBy("range", "row", "kind", "did", "n_chars", "edited_sha256")
        .agg(*lane_sums(F.col("paragraph")))
        .select("range", "row", "kind", "did", "n_chars", "edited_sha256", *lanes())
    )

    def of(kind: int, name: str) -> Column:
        value = F.first(F.when(F.col("kind") == kind, F.col(name)), ignorenulls=True)
        return value.alias(f"{name}{kind}")

    each = sums.groupBy("range", "row", "did", "n_chars", "edited_sha256").agg(
        of(0, "equal"), of(0, "signs"), of(1, "equal"), of(1, "signs"), of(2, "signs")
    )
    order = Window.partitionBy("range").orderBy("row")
    following = F.coalesce(F.lead("signs0").over(order), "signs2")
    return each.withColumn("next_signs", following).select(
        real_id().alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("equal0"), F.col("signs0")).alias("fingerprint"),
        as_text(F.col("equal1"), F.col("signs1")).alias("edited_fingerprint"),
        likeness(F.col("signs0"), F.col("signs1")).alias("near_edited"),
        likeness(F.col("signs0"), F.col("next_signs")).alias("near_next"),
    )
