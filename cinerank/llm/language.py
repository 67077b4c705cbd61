"""Language of a text by rank-order profiles of character n-grams.

A language's profile lists its ``PROFILE`` most frequent n-grams of one to three
characters over all training documents.  A document is compared by the sum of
out-of-place distances between its own most frequent n-grams and each profile.

Cost: one pass over the training texts, whose counts are added up per batch and
then by (language, n-gram), and one pass over all texts.  The profiles, a fixed
number of rows per language, are what reaches the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import batch, crc_slot

FOLDS, HELD_FOLD = 4, 2
PROFILE = 400
UNKNOWN = "und"
# Characters of text between two merges of a task's counts.
MERGE_CHARS = 1 << 20
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_BITS = 21


def grams(text: str) -> np.ndarray:
    """All n-grams as integers, 21 bits a character; words are set between spaces."""
    letters = _OTHER.sub(" ", text.lower()).strip()
    # Marks alone are no letters.
    if not _LETTER.search(letters):
        return np.empty(0, np.int64)
    one = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = one.astype(np.int64)
    two = (one[:-1] << _BITS) | one[1:]
    three = (two[:-1] << _BITS) | one[2:]
    return np.concatenate([one[one != 32], two, three])


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def ranked(values: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent values, ties by value."""
    codes, counts = counted(values)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts, starts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for rows in batches:
        held: dict[str, list] = {}
        pending: dict[str, int] = {}
        for lang, text in zip(rows.column("lang"), rows.column("text"), strict=True):
            values = grams(text.as_py())
            if not len(values):
                continue
            name = lang.as_py()
            parts = held.setdefault(name, [])
            parts.append(counted(values))
            pending[name] = pending.get(name, 0) + len(values)
            if pending[name] > MERGE_CHARS:
                held[name], pending[name] = [_merged(parts)], 0
        for name, parts in held.items():
            codes, counts = _merged(parts)
            yield batch(schema, [name] * len(codes), codes, counts)


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """n-grams of each language in the training documents, most frequent first."""
    known = docs.filter((crc_slot(FOLDS) != HELD_FOLD) & F.col("lang").isNotNull())
    counts = (
        known.filter(F.col("text").isNotNull())
        .select(F.col("lang").cast("string").alias("lang"), "text")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "rank", "gram").collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {
        lang: np.array([gram for _, gram in sorted(entries)], np.int64)
        for lang, entries in sorted(found.items())
    }


class Places:
    """Profiles prepared for looking up where an n-gram stands."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = list(by_language)
        self.sorted = [np.sort(p) for p in by_language.values()]
        self.ranks = [np.argsort(p) for p in by_language.values()]

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each profile; an absent n-gram costs ``PROFILE``."""
        here = np.arange(len(top))
        result = []
        for codes, ranks in zip(self.sorted, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
            apart = np.where(codes[at] == top, np.abs(ranks[at] - here), PROFILE)
            result.append(apart.sum())
        return np.array(result, float)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share of the closeness to all languages."""
        values = grams(text or "")
        if not len(values) or not self.languages:
            return UNKNOWN, 0.0
        top = ranked(values)
        apart = self.distances(top)
        best = int(np.argmin(apart))
        closeness = 1 - apart / (PROFILE * len(top))
        total = float(closeness.sum())
        return self.languages[best], float(closeness[best] / total) if total else 0.0


def _predict(places: Places):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [places.predict(text.as_py()) for text in rows.column("text")]
            yield batch(
                schema,
                rows.column("doc_id"),
                rows.column("held_out"),
                [f[0] for f in found],
                [f[1] for f in found],
            )

    return run


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 for a null text, one without letters, or if nothing was
    learned.  Ties go to the language that sorts first.  Null ids keep their rows;
    repeated rows are counted and answered each.
    """
    places = Places(profiles(docs))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_slot(FOLDS) == HELD_FOLD).alias("held_out"),
        "text",
    ).mapInArrow(
        _predict(places), "doc_id long, held_out boolean, lang_pred string, score double"
    )
