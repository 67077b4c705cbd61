"""Removing byte strings that also start earlier, by a suffix sort.

Places where long strings may repeat are found by equal anchors (see ``anchors``).
For every anchor with differing contexts the bytes around it are gathered, and the
suffixes that start there are sorted: a mergesort whose comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes, so one
comparison takes a logarithmic number of steps.  Neighbours with a common extension
of the full width are compared byte by byte, and all but the earliest go.

Cost: one row for about forty bytes of text for the anchors, one shuffle of the
compressed texts, and the bytes around the earliest of differing contexts.  Anchors
with more than ``MOST_CONTEXTS`` contexts are too large for one task; their windows
are matched by a 128-bit hash in a window over Spark rows instead, with the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.anchors import (
    OPEN,
    RUN,
    Rolling,
    Shape,
    bodies_of,
    by_document,
    merge_runs,
    mixed,
    powers,
    pressed,
    settle_anchors,
    smallest,
)
from cinerank.llm.common import batch, real_id
from cinerank.llm.substrings import WINDOWS, later_windows, open_windows
from cinerank.session import materialise

WIDTH = 100
GRAM = 30
MOST_CONTEXTS = 20_000
# Contexts that are sorted together, and rows of candidate suffixes.
CHUNK = 8_000


def byte_tokens(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64)


SHAPE = Shape(byte_tokens, WIDTH, GRAM, within=True)
_CONTEXTS = "key long, did long, tk long, place long, lead int, bytes binary"
_CONTEXT_SCHEMA = pa.schema(
    [
        ("key", pa.int64()),
        ("did", pa.int64()),
        ("tk", pa.int64()),
        ("place", pa.int64()),
        ("lead", pa.int32()),
        ("bytes", pa.binary()),
    ]
)
_RUNS = "did long, tk long, start long, end long"
_RUN_SCHEMA = pa.schema(
    [("did", pa.int64()), ("tk", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
)


def _gather(shape: Shape):
    """The bytes of all windows that an open anchor stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            marked = zip(
                rows.column("did").to_pylist(),
                rows.column("tk").to_pylist(),
                rows.column("marks").to_pylist(),
                bodies_of(rows.column("body")),
                strict=True,
            )
            for did, tk, marks, body in marked:
                chosen = smallest(
                    Rolling(shape.tokens(body)).windows(shape.gram), shape.reach + 1
                )
                # Windows of one anchor follow each other.
                places = np.array([m["start"] for m in marks], np.int64)
                low = np.searchsorted(chosen, places, "left")
                high = np.searchsorted(chosen, places, "right")
                for mark, a, b in zip(marks, low.tolist(), high.tolist(), strict=True):
                    text = body[a : b - 1 + shape.width]
                    out.append((mark["key"], did, tk, mark["start"], mark["start"] - a, text))
                if len(out) >= CHUNK:
                    yield batch(_CONTEXT_SCHEMA, *zip(*out, strict=True))
                    out = []
            if out:
                yield batch(_CONTEXT_SCHEMA, *zip(*out, strict=True))

    return run


class Suffixes:
    """Comparison of suffixes of a buffer, up to ``width`` bytes."""

    def __init__(self, buffer: bytes, width: int):
        self.bytes = np.frombuffer(buffer + bytes(width), np.uint8)
        self.width = width
        rolling = Rolling(self.bytes.astype(np.uint64))
        self.sums = rolling.sums
        self.whole = rolling.windows(width)
        self.power = powers(0x9E3779B97F4A7C15 | 1, max(1 << 16, 1 << len(self.sums).bit_length()))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning: binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.width)
        first, second = self.sums[a], self.sums[b]
        to_a, to_b = self.power[a], self.power[b]
        for _ in range(self.width.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.sums[a + middle] - first) * to_b == (self.sums[b + middle] - second) * to_a
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a is before, equal to (in ``width`` bytes) or after b."""
        result = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(self.whole[a] != self.whole[b])
        x, y = a[differ], b[differ]
        length = np.minimum(self.extension(x, y), self.width - 1)
        result[differ] = np.sign(
            self.bytes[x + length].astype(np.int16) - self.bytes[y + length].astype(np.int16)
        )
        return result

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, self.width)
        return np.concatenate(
            [
                (view[a[i : i + 65536]] == view[b[i : i + 65536]]).all(axis=1)
                for i in range(0, len(a), 65536)
            ]
            or [np.zeros(0, bool)]
        )


def sort_suffixes(suffixes: Suffixes, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order that sorts the suffixes within each group of neighbours, equal ones as they were.

    Bottom-up mergesort, all merges of a level at once: where an element goes is its
    place in its own run plus its rank in the sibling run, found by binary search.
    """
    n = len(place)
    order = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    begin = np.repeat(starts, sizes)
    end = begin + np.repeat(sizes, sizes)
    rank = np.arange(n) - begin
    run = 1
    while n and run < sizes.max():
        pair = begin + rank // (2 * run) * (2 * run)
        right = (rank // run) % 2 == 1
        other = np.where(right, pair, pair + run)
        active = np.flatnonzero(other < end)
        pair, right, other = pair[active], right[active], other[active]
        mine = place[order[active]]
        low = np.zeros(len(active), np.int64)
        high = np.minimum(run, end[active] - other)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            against = place[order[other[live] + middle]]
            sign = suffixes.compare(against, mine[live])
            # Of equals, those of the left run come first.
            before = (sign < 0) | ((sign == 0) & right[live])
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
        target = pair + rank[active] % run + low
        fresh = order.copy()
        fresh[target] = order[active]
        order = fresh
        run *= 2
    return order


def later_starts(
    keys: np.ndarray, leads: np.ndarray, texts: list[bytes], width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every window that an earlier context of its key has as well.

    Contexts are in document order; equal windows stand at equal distances before
    their anchors.
    """
    suffixes = Suffixes(b"".join(texts), width)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.r_[0, np.cumsum(size)[:-1]]
    count = size - width + 1
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = base[owner] + offset
    # Key and distance to the anchor; a chunk has far fewer keys than 2^40.
    number = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
    group = number[owner] * (1 << 20) + (leads[owner] - offset)
    # A suffix whose prefix hash no other of its group has repeats nowhere.
    code = mixed(suffixes.whole[place] ^ mixed(group.astype(np.uint64)))
    by_code = np.argsort(code, kind="stable")
    same = code[by_code[1:]] == code[by_code[:-1]]
    twin = np.zeros(len(code), bool)
    twin[by_code[1:]] |= same
    twin[by_code[:-1]] |= same
    left = np.flatnonzero(twin)
    left = left[np.lexsort((owner[left], group[left]))]
    order = left[sort_suffixes(suffixes, place[left], group[left])]
    near = (group[order[1:]] == group[order[:-1]]) & (
        suffixes.whole[place[order[1:]]] == suffixes.whole[place[order[:-1]]]
    )
    near[near] = suffixes.equal_bytes(place[order[:-1]][near], place[order[1:]][near])
    later = order[1:][near]
    return owner[later], offset[later]


def _resolve(width: int):
    """Runs from contexts that come sorted by key, did, tk and place."""

    def settled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        texts = rows.column("bytes").to_pylist()
        lead = rows.column("lead").to_numpy()
        owner, offset = later_starts(rows.column("key").to_numpy(), lead, texts, width)
        if not len(owner):
            return
        span = int(max(map(len, texts))) + 2
        low = owner * span + offset
        low, high = merge_runs(low, low + width)
        owner = low // span
        start = rows.column("place").to_numpy()[owner] - lead[owner] + low - owner * span
        did, tk = rows.column("did").to_numpy()[owner], rows.column("tk").to_numpy()[owner]
        yield batch(_RUN_SCHEMA, did, tk, start, start + high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            key = rows.column("key").to_numpy()
            begin = 0
            for edge in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
                first = rows.column("key")[begin]
                if size >= CHUNK and held[-1].column("key")[-1] != first:
                    yield from settled(held)
                    held, size = [], 0
                if edge - begin and (edge == len(key) or size + edge - begin >= CHUNK):
                    held.append(rows.slice(begin, edge - begin))
                    size += edge - begin
                    begin = edge
        if held:
            yield from settled(held)

    return run


def repeated_bytes(
    docs: DataFrame, texts: DataFrame, shape: Shape = SHAPE, most: int = MOST_CONTEXTS
) -> DataFrame:
    """did, tk, start, end of stretches all of whose windows also start earlier."""
    settled = materialise(settle_anchors(docs, shape), "anchors")
    opened = settled.filter(F.col("kind") == OPEN).select("key", "did", "tk", "start")
    crowded = opened.groupBy("key").count().filter(F.col("count") > most)
    opened = opened.join(crowded.select("key", F.lit(True).alias("crowded")), "key", "left")

    def around(which: DataFrame, *columns: str) -> DataFrame:
        marks = by_document(which, *columns)
        return texts.join(marks, ["did", "tk"], "left").filter(F.col("marks").isNotNull())

    sorted_out = (
        around(opened.filter(F.col("crowded").isNull()), "key", "start")
        .mapInArrow(_gather(shape), _CONTEXTS)
        .repartition("key")
        .sortWithinPartitions("key", "did", "tk", "place")
        .mapInArrow(_resolve(shape.width), _RUNS)
    )
    matched = later_windows(
        around(opened.filter(F.col("crowded").isNotNull()), "start").mapInArrow(
            open_windows(shape), WINDOWS
        ),
        shape,
    )
    runs = settled.filter(F.col("kind") == RUN).select("did", "tk", "start", "end")
    return runs.unionByName(sorted_out).unionByName(matched)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("did", pa.int64()),
            ("n_bytes", pa.int64()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
            ("kept", pa.large_binary()),
        ]
    )
    for rows in batches:
        sizes, spans, kept = [], [], []
        for marks, body in zip(rows.column("marks"), bodies_of(rows.column("body")), strict=True):
            n = len(body)
            found = marks.as_py() or []
            low, high = merge_runs(
                np.array([m["start"] for m in found], np.int64),
                np.minimum(np.array([m["end"] for m in found], np.int64), n),
            )
            edges = [0, *np.c_[low, high].ravel().tolist(), n]
            sizes.append(n)
            spans.append(np.c_[low, high].tolist())
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield batch(schema, rows.column("did"), sizes, spans, kept)


def dedup_suffixes(docs: DataFrame, shape: Shape = SHAPE, most: int = MOST_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans, kept.

    ``spans`` are the maximal removed runs as [first byte, first byte after]; ``kept``
    the remaining bytes, which need not be whole UTF-8 characters.  A null text is
    empty.  Texts shorter than the width lose nothing.  A null doc_id comes before all
    others; rows that share a doc_id and differ in text are ordered by a hash of the
    text, and a row repeated as it is counts as one document.
    """
    texts = pressed(docs)
    marks = by_document(repeated_bytes(docs, texts, shape, most), "start", "end")
    return (
        texts.join(marks, ["did", "tk"], "left")
        .mapInArrow(_kept, "did long, n_bytes long, spans array<array<long>>, kept binary")
        .select(real_id().alias("doc_id"), "n_bytes", "spans", "kept")
    )
