"""Removing word windows that an earlier document already has.

Every window of ``WINDOW`` words has a Rabin-Karp hash.  Windows whose place is
not settled by equal anchor contexts (see ``anchors``) are counted in Spark by a
hash of 128 bits; a window that also starts in a smaller document goes, and
overlapping windows merge into maximal intervals.

Cost: anchors are one row for about twenty words; texts are shuffled once,
compressed; windows move only for the earliest of differing contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.anchors import (
    OPEN,
    RUN,
    Rolling,
    Shape,
    bodies_of,
    by_document,
    merge_runs,
    pressed,
    settle_anchors,
    smallest,
)
from cinerank.llm.common import batch, real_id
from cinerank.session import materialise

WINDOW = 50
GRAM = 10


def word_hashes(text: bytes) -> np.ndarray:
    # bytes.split() splits at the six ASCII white space characters.
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


SHAPE = Shape(word_hashes, WINDOW, GRAM, within=False)
WINDOWS = "kind int, h1 long, h2 long, did long, tk long, start long, end long"
_WINDOW_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("h1", pa.int64()),
        ("h2", pa.int64()),
        ("did", pa.int64()),
        ("tk", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
    ]
)


def window_hashes(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return Rolling(tokens, 0).windows(width), Rolling(tokens, 1).windows(width)


def _rows(kind: int, h1, h2, did, tk, start, end) -> pa.RecordBatch:
    return batch(
        _WINDOW_SCHEMA,
        np.full(len(start), kind, np.int32),
        h1.view(np.int64),
        h2.view(np.int64),
        did,
        tk,
        start,
        end,
    )


def open_windows(shape: Shape):
    """Windows whose anchor is open, each hash once per batch; later ones are runs at once."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[2]) for h in held]
        doc = np.repeat(np.arange(len(held)), sizes)
        h1, h2, start = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        did = np.array([h[0] for h in held], np.int64)
        tk = np.array([h[1] for h in held], np.int64)
        order = np.lexsort((start, doc, h2, h1))
        doc, h1, h2, start = doc[order], h1[order], h2[order], start[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = ~new if shape.within else doc != doc[first]
        yield _rows(OPEN, h1[new], h2[new], did[doc[new]], tk[doc[new]], start[new], start[new])
        if later.any():
            doc, start = doc[later], start[later]
            span = int(start.max()) + shape.width + 2
            low, high = merge_runs(start + doc * span, start + shape.width + doc * span)
            doc = low // span
            spread = low.astype(np.uint64)
            yield _rows(RUN, spread, spread, did[doc], tk[doc], low - doc * span, high - doc * span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held: dict[tuple[int, int], tuple] = {}
            size = 0
            marked = zip(
                rows.column("did").to_pylist(),
                rows.column("tk").to_pylist(),
                rows.column("marks"),
                bodies_of(rows.column("body")),
                strict=True,
            )
            for did, tk, marks, body in marked:
                tokens = shape.tokens(body)
                places = np.array([m["start"] for m in marks.as_py()], np.int64)
                grams = Rolling(tokens).windows(shape.gram)
                mine = np.isin(smallest(grams, shape.reach + 1), places)
                h1, h2 = window_hashes(tokens, shape.width)
                start = np.flatnonzero(mine)
                held[did, tk] = (did, tk, h1[start], h2[start], start)
                size += len(start)
                if size >= 1 << 19:
                    yield from settle([held[k] for k in sorted(held)])
                    held, size = {}, 0
            if size:
                yield from settle([held[k] for k in sorted(held)])

    return run


def later_windows(windows: DataFrame, shape: Shape) -> DataFrame:
    """did, tk, start, end of windows that are not the first with their hash."""
    same = Window.partitionBy("h1", "h2")
    here = F.struct("did", "tk", "start") if shape.within else F.struct("did", "tk")
    return (
        windows.withColumn("first", F.min(here).over(same))
        .filter((F.col("kind") == RUN) | (here > F.col("first")))
        .select(
            "did",
            "tk",
            "start",
            F.when(F.col("kind") == RUN, F.col("end"))
            .otherwise(F.col("start") + shape.width)
            .alias("end"),
        )
    )


def repeated_windows(docs: DataFrame, texts: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """did, tk, start, end of stretches whose windows an earlier document has."""
    settled = materialise(settle_anchors(docs, shape), "anchors")
    opened = by_document(settled.filter(F.col("kind") == OPEN), "start")
    windows = (
        texts.join(opened, ["did", "tk"], "left")
        .filter(F.col("marks").isNotNull())
        .mapInArrow(open_windows(shape), WINDOWS)
    )
    return (
        settled.filter(F.col("kind") == RUN)
        .select("did", "tk", "start", "end")
        .unionByName(later_windows(windows, shape))
    )


def removal(tokens: np.ndarray, marks: list[dict], shape: Shape) -> np.ndarray:
    """Which tokens go: marked stretches, and windows of the document equal to one of theirs."""
    n = len(tokens)
    low, high = merge_runs(
        np.array([m["start"] for m in marks], np.int64),
        np.minimum(np.array([m["end"] for m in marks], np.int64), n),
    )
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, low, 1)
    np.add.at(covered, high, -1)
    inside = np.zeros(n - shape.width + 2, np.int64)
    np.add.at(inside, low, 1)
    np.add.at(inside, high - shape.width + 1, -1)
    known = np.cumsum(inside)[:-1] > 0
    h1, h2 = window_hashes(tokens, shape.width)
    again = np.flatnonzero(np.isin(h1, h1[known]) & np.isin(h2, h2[known]) & ~known)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + shape.width, -1)
    return np.cumsum(covered)[:-1] > 0


def _kept(shape: Shape):
    schema = pa.schema(
        [
            ("did", pa.int64()),
            ("n_words", pa.int64()),
            ("intervals", pa.list_(pa.list_(pa.int32()))),
            ("kept", pa.large_binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts, spans, kept = [], [], []
            marked = zip(rows.column("marks"), bodies_of(rows.column("body")), strict=True)
            for marks, body in marked:
                words = body.split()
                counts.append(len(words))
                if not marks.is_valid:
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                gone = removal(shape.tokens(body), marks.as_py(), shape)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append(edges.reshape(-1, 2).tolist())
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield batch(schema, rows.column("did"), counts, spans, kept)

    return run


def dedup_substrings(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """One row per document: doc_id, n_words, intervals, kept.

    ``intervals`` are the maximal removed runs as [first word, first word after];
    ``kept`` is the UTF-8 of the words that stay, joined by blanks.  A null text has
    no words.  Documents shorter than a window lose nothing.  A null doc_id comes
    before all others; rows that share a doc_id and differ in text are ordered by a
    hash of the text, and a row repeated as it is counts as one document.
    """
    texts = pressed(docs)
    marks = by_document(repeated_windows(docs, texts, shape), "start", "end")
    return (
        texts.join(marks, ["did", "tk"], "left")
        .mapInArrow(_kept(shape), "did long, n_words long, intervals array<array<int>>, kept binary")
        .select(real_id().alias("doc_id"), "n_words", "intervals", "kept")
    )


