"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics.  For each class the mean
and a covariance are estimated, the covariance shrunk towards the pooled one and
towards its diagonal; a score is the logistic of the difference of the two
log densities, whose Mahalanobis distances use Cholesky factors computed once.

Cost: one pass over all texts to find the vectors of labelled documents (only
vectors are shuffled), grouped sums of first and second moments, and one pass to
score.  What reaches the driver is a number of sums fixed by the vector's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import batch, crc_slot, texts_of

FOLDS = 5
ACCEPT = 0.3
# Weight of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.1, 0.05
BLOCK = 24
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PLAIN_END = frozenset(b".,;:?'\"()-")
NAMES = (
    "chars", "words", "word_length", "upper", "symbols", "digits", "distinct", "repeats",
    "commonest", "bare", "marked", "short", "same_lines", "entropy", "worst_repeat", "worst_marked",
)


def _share(count: float, total: float) -> float:
    """Log-odds of a share, finite at 0 and 1 and close to them for short texts."""
    return float(np.log((count + 0.5) / (max(total - count, 0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The vector of one text; an empty text has the vector of no counts."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n_bytes = len(text)
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    visible = histogram[33:].sum()
    letters = histogram[_WORDY].sum()
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    repeat = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, max(n - 1, 0))
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    size = np.fromiter(map(len, words), np.int64, n)
    bare = (size == 1) & ~_WORDY[last]
    plain = _WORDY[last] | np.isin(last, list(_PLAIN_END))
    marked = ~plain & ~bare
    odd = np.zeros(n, np.int64)
    odd[1:] = repeat
    worst_repeat = worst_marked = 0.0
    if n:
        edges = np.arange(0, n, BLOCK)
        worst_repeat = float(np.add.reduceat(odd, edges).max())
        worst_marked = float(np.add.reduceat((marked | bare).astype(np.int64), edges).max())
    frequencies = histogram[histogram > 0] / max(n_bytes, 1)
    return [
        float(np.log1p(n_bytes)),
        float(np.log1p(n)),
        float(np.log1p(size.mean() if n else 0.0)),
        _share(histogram[_UPPER].sum(), letters),
        _share(visible - letters, visible),
        _share(histogram[48:58].sum(), visible),
        _share(len(counts), n),
        _share(repeat.sum(), n),
        _share(max(counts.values(), default=0), n),
        _share(bare.sum(), n),
        _share(marked.sum(), n),
        _share((size <= 3).sum(), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(-(frequencies * np.log(frequencies)).sum()),
        _share(worst_repeat, BLOCK),
        _share(worst_marked, BLOCK),
    ]


def vectors(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts_of(texts)]).reshape(-1, len(NAMES))


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("vector", pa.list_(pa.float64()))])
    for rows in batches:
        yield batch(schema, rows.column("doc_id"), vectors(rows.column("text")).tolist())


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: 1, x and the products of x, summed over the partition."""
    schema = pa.schema([("label", pa.int32()), ("position", pa.int32()), ("value", pa.float64())])
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        labels = rows.column("label").to_numpy(zero_copy_only=False)
        held = np.array(rows.column("vector").to_pylist()).reshape(len(labels), -1)
        for label in np.unique(labels):
            x = np.c_[np.ones((labels == label).sum()), held[labels == label]]
            sums[int(label)] = sums.get(int(label), 0) + (x.T @ x).ravel()
    for label, value in sums.items():
        yield batch(schema, np.full(len(value), label), np.arange(len(value)), value)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants, for labels 0 and 1."""

    prior: float
    means: np.ndarray | None = None
    roots: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [
            -0.5 * ((((x - self.means[k]) @ self.roots[k].T) ** 2).sum(axis=1) + self.log_dets[k])
            for k in (0, 1)
        ]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def scorer(self, text: Column) -> Column:
        """Score of a text column, in Arrow batches."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            return pa.array(model.score(vectors(texts)), pa.float64())

        return scored(text)


def from_moments(moments: dict[int, np.ndarray]) -> Discriminant:
    """``moments[label]`` is the matrix of summed products of (1, x)."""
    counts = [moments[k][0, 0] if k in moments else 0.0 for k in (0, 1)]
    total = sum(counts)
    if not total:
        return Discriminant(0.5)
    if min(counts) == 0:
        return Discriminant(float(counts[1] / total))
    means = [moments[k][0, 1:] / counts[k] for k in (0, 1)]
    own = [moments[k][1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(c * s for c, s in zip(counts, own, strict=True)) / total
    spread = np.diag(np.maximum(np.diag(pooled), 1e-3))
    # A class seen a few times only leans on the pooled covariance.
    width = len(spread)
    roots, log_dets = [], []
    for count, covariance in zip(counts, own, strict=True):
        pool = max(POOLED, width / (width + count))
        mixed = (1 - pool - DIAGONAL * (1 - pool)) * covariance
        mixed = mixed + pool * pooled + DIAGONAL * (1 - pool) * spread + 1e-6 * spread
        lower = np.linalg.cholesky((mixed + mixed.T) / 2 + 1e-9 * np.eye(width))
        roots.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(
        float(counts[1] / total), np.array(means), np.array(roots), np.array(log_dets)
    )


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from labelled documents outside fold 0; null labels and ids teach nothing.

    A document labelled twice counts twice.  Without labels every score is a half,
    with one class only it is that class.
    """
    taught = labels.filter(crc_slot(FOLDS) != 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _vector_rows, "doc_id long, vector array<double>"
    )
    sums = (
        found.join(taught.filter("label IN (0, 1)"), "doc_id")
        .select("label", "vector")
        .mapInArrow(_moments, "label int, position int, value double")
        .groupBy("label", "position")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    side = len(NAMES) + 1
    moments: dict[int, np.ndarray] = {}
    for row in sums:
        moments.setdefault(row["label"], np.zeros((side, side))).flat[row["position"]] = row["value"]
    return from_moments(moments)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by the vector of no counts.  A null doc_id keeps
    its row.  Repeated rows get equal scores.
    """
    model = fit(docs, labels)
    return docs.select(
        F.col("doc_id"),
        (crc_slot(FOLDS) == 0).alias("held_out"),
        model.scorer(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
