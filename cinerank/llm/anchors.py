"""Finding repeated windows of long sequences without moving every window.

A window of ``width`` tokens is known by the smallest hash among its runs of
``gram`` tokens, its anchor.  Equal windows have equal anchors at equal places, so
windows need comparing only where anchors are equal.  An anchor is selected once
for about ``(width - gram) / 2`` tokens; with it goes a hash of its context, all
tokens of all windows that contain it.

* Where contexts are equal, every window in them repeats: all but the earliest
  document's are settled without a look at their windows.
* Where an anchor has several contexts, the earliest of each goes on, to be
  compared window by window.

Repeats inside a batch of documents are settled before the shuffle, so a text
that is in a third of all documents sends one row per batch and anchor.  The
shuffled rows are sorted, and read as a stream: no group is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import batch, keyed, texts_of

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
# Positions handled at once; a longer sequence is cut, with overlaps.
STRETCH = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
# Anchors of a batch that are compared before they are sent.
FLUSH = 1 << 20

ROWS = "kind int, key long, ctx long, did long, tk long, start long, end long"
ROW_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.int64()),
        ("ctx", pa.int64()),
        ("did", pa.int64()),
        ("tk", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
    ]
)
OPEN, RUN = 0, 1


@dataclass(frozen=True)
class Shape:
    """How a text becomes tokens, and what counts as a repeat.

    ``within``: a window that starts earlier in the same document counts too.
    """

    tokens: Callable[[bytes], np.ndarray]
    width: int
    gram: int
    within: bool

    @property
    def reach(self) -> int:
        """Tokens before an anchor that its windows can hold."""
        return self.width - self.gram


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    table = np.full(size, np.uint64(base))
    table[0] = 1
    return np.multiply.accumulate(table)


def _table(lane: int, size: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..size-1 of a lane's base, or of its inverse modulo 2^64."""
    base = _BASES[lane] | 1
    base = pow(base, -1, 1 << 64) if inverse else base
    return powers(base, max(1 << 16, 1 << (size - 1).bit_length()))[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _HALF)) * _MIX
    return (values ^ (values >> _HALF)) * _MIX


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of any stretch of a sequence."""

    def __init__(self, tokens: np.ndarray, lane: int = 0):
        n = len(tokens)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((tokens + np.uint64(1)) * _table(lane, max(n, 1))[:n], out=self.sums[1:])
        self.back = _table(lane, n + 1, inverse=True)

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` tokens."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * self.back[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def smallest(hashes: np.ndarray, count: int) -> np.ndarray:
    """Place of the first smallest of every ``count`` consecutive hashes.

    Hashes are compared by the bits that a place leaves free, so they are taken by
    stretches, with overlaps, of no more places than those bits can number.
    """
    found = [
        begin + _smallest(hashes[begin : begin + STRETCH + count - 1], count)
        for begin in range(0, max(len(hashes) - count + 1, 1), STRETCH)
    ]
    return np.concatenate(found)


def _smallest(hashes: np.ndarray, count: int) -> np.ndarray:
    if len(hashes) > int(_PLACE) + 1:
        raise ValueError(f"{len(hashes)} hashes do not fit the bits of a place")
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while 2 * step <= count:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < count:
        key = np.minimum(key[: -(count - step)], key[count - step :])
    return (key & _PLACE).astype(np.int64)


def anchors(tokens: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of a sequence's anchors, by place."""
    n, width, reach = len(tokens), shape.width, shape.reach
    found = []
    for begin in range(0, max(n - width + 1, 0), STRETCH):
        low = max(0, begin - width)
        part = tokens[low : begin + STRETCH + 2 * width]
        rolling = Rolling(part)
        grams = rolling.windows(shape.gram)
        first = begin - low
        last = min(begin + STRETCH, n - width + 1) - low
        place = np.unique(first + smallest(grams[first : last + reach], reach + 1))
        left = np.minimum(place + low, reach)
        right = np.minimum(n - low - place, width)
        around = rolling.spans(place - left, place + right)
        extent = (left * (width + 1) + right).astype(np.uint64)
        found.append((place + low, grams[place], mixed(around ^ (extent * _MIX))))
    if not found:
        none = np.empty(0, np.uint64)
        return none.astype(np.int64), none, none
    place, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
    # A stretch's last anchors may be the next one's first.
    _, once = np.unique(place, return_index=True)
    return place[once], key[once], ctx[once]


def merge_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _emit(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return batch(
        ROW_SCHEMA,
        *(
            rows[name].view(np.int64) if rows[name].dtype == np.uint64 else rows[name]
            for name in ROW_SCHEMA.names
        ),
    )


def _settle_batch(shape: Shape, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the anchors of some documents, repeats among them settled.

    held: did, tk, places, keys, contexts of each document, sorted by (did, tk).
    """
    sizes = [len(h[2]) for h in held]
    doc = np.repeat(np.arange(len(held)), sizes)
    place, key, ctx = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
    did = np.array([h[0] for h in held], np.int64)
    tk = np.array([h[1] for h in held], np.int64)
    order = np.lexsort((place, doc, ctx, key))
    doc, place, key, ctx = doc[order], place[order], key[order], ctx[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    settled = ~new & ((doc != doc[first]) | shape.within)
    yield _emit(
        {
            "kind": np.full(new.sum(), OPEN, np.int32),
            "key": key[new],
            "ctx": ctx[new],
            "did": did[doc[new]],
            "tk": tk[doc[new]],
            "start": place[new],
            "end": place[new],
        }
    )
    if settled.any():
        # Merged per document before they are sent.
        doc, place = doc[settled], place[settled]
        low, high = np.maximum(place - shape.reach, 0), place + shape.width
        span = int(high.max()) + 2
        low, high = merge_runs(low + doc * span, high + doc * span)
        doc = low // span
        yield _emit(
            {
                "kind": np.full(len(doc), RUN, np.int32),
                "key": mixed(low.astype(np.uint64)),
                "ctx": np.zeros(len(doc), np.int64),
                "did": did[doc],
                "tk": tk[doc],
                "start": low - doc * span,
                "end": high - doc * span,
            }
        )


def _anchor_rows(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held: dict[tuple[int, int], tuple] = {}
            size = 0
            ids = zip(rows.column("did").to_pylist(), rows.column("tk").to_pylist(), strict=True)
            for (did, tk), text in zip(ids, texts_of(rows.column("text")), strict=True):
                found = anchors(shape.tokens(text), shape)
                if len(found[0]):
                    # The same document again adds nothing.
                    held[did, tk] = (did, tk, *found)
                    size += len(found[0])
                if size >= FLUSH:
                    yield from _settle_batch(shape, [held[k] for k in sorted(held)])
                    held, size = {}, 0
            if held:
                yield from _settle_batch(shape, [held[k] for k in sorted(held)])

    return run


def _settle_sorted(shape: Shape):
    """Settles anchors that come sorted by kind, key, ctx, did, tk, start; keeps runs.

    Gives the runs of all but the first of equal contexts, and the first of each
    context of keys that have several.
    """
    names = ROW_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict | None = None  # the current context's first row
        pending: dict[str, np.ndarray] | None = None  # the current key's only context so far
        several = False  # the current key has several contexts, already given
        for rows in batches:
            if not rows.num_rows:
                continue
            columns = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in names}
            ready = columns["kind"] == RUN
            if ready.any():
                yield _emit({n: v[ready] for n, v in columns.items()})
                columns = {n: v[~ready] for n, v in columns.items()}
                if not len(columns["kind"]):
                    continue
            key, ctx, did, tk, place = (columns[n] for n in ("key", "ctx", "did", "tk", "start"))
            same = carry is not None and carry["key"] == key[0] and carry["ctx"] == ctx[0]
            new = np.r_[not same, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            begun = first < 0
            at = np.maximum(first, 0)
            first_did = np.where(begun, carry["did"] if same else 0, did[at])
            first_tk = np.where(begun, carry["tk"] if same else 0, tk[at])
            first_place = np.where(begun, carry["place"] if same else 0, place[at])
            other = (did != first_did) | (tk != first_tk)
            if shape.within:
                other |= place != first_place
            settled = other & ~new
            if settled.any():
                yield _emit(
                    {
                        "kind": np.full(settled.sum(), RUN, np.int32),
                        "key": key[settled],
                        "ctx": np.zeros(settled.sum(), np.int64),
                        "did": did[settled],
                        "tk": tk[settled],
                        "start": np.maximum(place[settled] - shape.reach, 0),
                        "end": place[settled] + shape.width,
                    }
                )
            opened = {n: v[new] for n, v in columns.items()}
            continues = carry is not None and len(key) and carry["key"] == key[0]
            if continues and pending is not None:
                opened = {n: np.concatenate([pending[n], opened[n]]) for n in names}
            carry = {
                "key": key[-1],
                "ctx": ctx[-1],
                "did": first_did[-1],
                "tk": first_tk[-1],
                "place": first_place[-1],
            }
            if not continues:
                several = False
            pending = None
            if not len(opened["key"]):
                several = several and key[-1] == key[0]
                continue
            keys = opened["key"]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            give = sizes > 1
            if continues and several and keys[0] == key[0]:
                give[0] = True
            if keys[-1] == key[-1]:
                last_several = bool(give[-1])
                if not last_several:
                    pending = {n: v[-1:] for n, v in opened.items()}
            else:
                last_several = several and key[-1] == key[0]
            several = last_several
            mask = np.repeat(give, sizes)
            if mask.any():
                yield _emit({n: v[mask] for n, v in opened.items()})

    return run


def settle_anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """Rows of kind ``RUN``: repeated stretches (did, tk, start, end), end not clipped to
    the text; of kind ``OPEN``: anchors (key, did, tk, start) whose windows are to be
    compared with those of other rows with their key."""
    return (
        keyed(docs)
        .mapInArrow(_anchor_rows(shape), ROWS)
        .repartition("key")
        .sortWithinPartitions("kind", "key", "ctx", "did", "tk", "start")
        .mapInArrow(_settle_sorted(shape), ROWS)
    )


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("body", pa.binary())])
    press = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        bodies = [press.compress(t) for t in texts_of(rows.column("text"))]
        yield batch(schema, rows.column("did"), rows.column("tk"), bodies)


def pressed(docs: DataFrame) -> DataFrame:
    """did, tk and the compressed text.

    Joined twice on (did, tk) in one plan, it is shuffled once: with its keys known to
    be there, the plans of an inner and an outer join read the same exchange.
    """
    packed = keyed(docs).mapInArrow(_press, "did long, tk long, body binary")
    return packed.filter(F.col("did").isNotNull() & F.col("tk").isNotNull())


def bodies_of(column: pa.Array) -> Iterator[bytes]:
    open_ = zstandard.ZstdDecompressor()
    for body in column:
        yield open_.decompress(body.as_py())


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each document as one array, which its length bounds."""
    return rows.groupBy("did", "tk").agg(F.collect_list(F.struct(*columns)).alias("marks"))
