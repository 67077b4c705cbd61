"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text tile its bytes.  Offsets where a token of each ends cut
them into groups; every stretch between neighbouring ends of either lies in one token of
each, and is a link between the two.

A byte range of a text yields a fragment: the tokens before its first cut (an open
prefix), closed groups, and the tokens after its last cut (an open suffix).  Fragments
compose: the suffix of one and the prefix of the next are one group, and a fragment
without a cut lengthens its neighbour.  Composition is associative, so the fragments of
a very long text, made by as many tasks as it has ranges, are composed by a tree of
groupings.  Closed groups stay where they were made; only open ends move.

Texts are tokenised piece by piece, cut before single blanks, across which no token of
either tokenizer reaches; a task remembers the pieces it has met.  Links are numbered
within blocks of about ``BLOCK_BYTES`` of text.  A block sends each distinct pair of ids
once, counts are added up in Spark, and each pair's count returns to the blocks that
have it.  A block is the unit of memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.blocks import squeeze, unsqueeze
from cinerank.llm.bpe import pieces as byte_pieces
from cinerank.llm.common import batch, texts_of
from cinerank.operators.skew import lookup_join
from cinerank.session import materialise

# A longer text is cut into ranges of this many bytes, each a row of its own.
RANGE_BYTES = 1 << 16
BLOCK_BYTES = 3 << 20
# Fragments composed by one step of the tree.
FAN = 8
# Pieces that a task remembers, and the length up to which it does.
REMEMBERED = 300_000
PIECE_BYTES = 64
# New pieces that are encoded together.
LINE = 256

_GAP = re.compile(rb"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
_RUN = re.compile(rb"[\s\x1c-\x1f][\s\x1c-\x1f]")
_LOW = np.int64(0xFFFFFFFF)

_PART = "doc_id long, name string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = f"parts array<struct<{_PART.replace(' long', ': long').replace(' string', ': string')}>>, pairs array<long>, times array<long>, links binary"
_RANGES = "did long, name string, copies long, idx long, low long, begin long, end long, body binary"
_OPEN = "did long, name string, copies long, at long, first long, cut boolean, ok boolean, pa binary, pb binary, sa binary, sb binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split(" ") for field in ddl.split(", "))])


_PART_TYPE = pa.struct(list(_schema(_PART)))
_BLOCK_SCHEMA = pa.schema(
    [
        ("parts", pa.list_(_PART_TYPE)),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
        ("links", pa.binary()),
    ]
)


class Paths(NamedTuple):
    """Files of the two tokenizers, readable on every machine: a tokenizers file with
    byte-level words, and a sentencepiece model that adds a blank."""

    a: str
    b: str


@lru_cache(maxsize=2)
def _sentence_pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        is_byte = model.is_byte(i)
        table.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
    return model, table


@lru_cache(maxsize=2)
def _plain_tokenizer(path: str):
    # Tasks share the cores already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    # Strings of special tokens in a text are plain text.
    loaded.encode_special_tokens = True
    return loaded


def text_pieces(text: bytes) -> list[bytes]:
    """Parts of a text between single blanks, without those."""
    if _RUN.search(text) or text[:1] == b" " or text[-1:] == b" ":
        return _GAP.split(text)
    return text.split(b" ")


class Tokens(NamedTuple):
    a: np.ndarray
    b: np.ndarray


_NONE = Tokens(np.empty(0, np.uint32), np.empty(0, np.uint32))


class Encoder:
    """Ids of whole texts by both tokenizers."""

    def __init__(self, paths: Paths):
        self.tokenizer = _plain_tokenizer(paths.a)
        self.model, table_b = _sentence_pieces(paths.b)
        table_a = [piece or b"" for piece in byte_pieces(paths.a).to_pylist()]
        self.tables = (table_a, table_b)
        self.sizes = tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in self.tables)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        # Pieces whose tokens do not spell them.
        self.bad: set[bytes] = set()

    def _spell(self, lines: list[list[bytes]]) -> None:
        """Learn lines of pieces, each line encoded as one text and cut at its pieces."""
        texts = [b" ".join(line).decode("utf-8", "replace") for line in lines]
        encoded = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        both = ([e.ids for e in encoded], self.model.encode(texts, num_threads=1))
        for line, *ids in zip(lines, *both, strict=True):
            ends = np.cumsum(np.fromiter(map(len, line), np.int64, len(line)) + 1)
            whole, spelled = b" " + b" ".join(line), []
            for numbers, table, sizes in zip(ids, self.tables, self.sizes, strict=True):
                if b"".join([table[i] for i in numbers]) != whole:
                    break
                flat = np.array(numbers, np.uint32)
                until = 4 * (np.searchsorted(np.cumsum(sizes[flat]), ends) + 1)
                raw, until = flat.tobytes(), until.tolist()
                spelled.append([raw[a:b] for a, b in zip([0, *until], until)])
            else:
                self.known.update(zip(line, zip(*spelled, strict=True), strict=True))
                continue
            if len(line) == 1:
                self.known[line[0]] = (b"", b"")
                self.bad.add(line[0])
            else:
                self._spell([[piece] for piece in line])

    def _learn(self, pieces: list[bytes]) -> None:
        # Blanks at the ends of a text would join those between pieces.
        alone = [piece for piece in pieces if piece != piece.strip() or not piece]
        rest = [piece for piece in pieces if piece and piece == piece.strip()]
        self._spell([[p] for p in alone] + [rest[i : i + LINE] for i in range(0, len(rest), LINE)])

    def encode(self, texts: list[list[bytes]]) -> list[Tokens | None]:
        """Ids of a blank and each text; None where tokens do not spell it."""
        distinct = set().union(*texts)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known, self.bad = {}, set()
        new = [piece for piece in distinct if piece not in self.known]
        if new:
            self._learn(new)
        known, found = self.known, []
        for pieces in texts:
            if self.bad and not self.bad.isdisjoint(pieces):
                found.append(None)
                continue
            ids = [known[p] for p in pieces]
            raw = b"".join([a for a, _ in ids]), b"".join([b for _, b in ids])
            found.append(Tokens(*(np.frombuffer(r, np.uint32) for r in raw)))
        for piece in new:
            if len(piece) > PIECE_BYTES:
                del known[piece]
                self.bad.discard(piece)
        return found


class Aligned(NamedTuple):
    """Links and groups of texts side by side, each of which begins and ends with a cut.

    For each stretch between ends, which is a link: the token of either that holds it, and
    whether it ends with a cut.  For each token: the number of its group.
    """

    ai: np.ndarray
    bi: np.ndarray
    common: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    size = int(ends_a[-1]) + 1 if len(ends_a) else 0
    in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
    in_a[ends_a] = True
    in_b[ends_b] = True
    ends = np.flatnonzero(in_a | in_b)
    # Ends before a place number the token that reaches it.
    before = [(np.cumsum(m, dtype=np.int32) - m)[ends] for m in (in_a, in_b)]
    both = in_a & in_b
    groups = np.cumsum(both, dtype=np.int32) - both
    return Aligned(*before, both[ends], groups[ends_a], groups[ends_b])


@lru_cache(maxsize=8)
def _spelled(count: int, mark: str) -> np.ndarray:
    """Decimal numbers, each with a mark after it, in cells of eight bytes."""
    return np.array([f"{i}{mark}".encode() for i in range(count)], "S8").view(np.uint64)


def group_texts(tokens: Tokens, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;`` each, and where each group's text ends."""
    count = 1 + int(max(tokens.a.max(initial=0), tokens.b.max(initial=0)))
    count = 1 << max(10, (count - 1).bit_length())
    if count > 10_000_000:
        raise ValueError("ids of more than seven digits")
    at_a, at_b = found.group_a, found.group_b
    sizes_a, sizes_b = np.bincount(at_a), np.bincount(at_b)
    until_a, until_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cells = np.empty(len(at_a) + len(at_b), np.uint64)
    place_a = np.arange(len(at_a)) + (until_b - sizes_b)[at_a]
    place_b = np.arange(len(at_b)) + until_a[at_b]
    cells[place_a] = _spelled(count, ",")[tokens.a]
    cells[place_b] = _spelled(count, ",")[tokens.b]
    cells[place_a[until_a - 1]] = _spelled(count, "|")[tokens.a[until_a - 1]]
    cells[place_b[until_b - 1]] = _spelled(count, ";")[tokens.b[until_b - 1]]
    used = cells.view(np.uint8) != 0
    ends = np.cumsum(np.bitwise_count(np.packbits(used)), dtype=np.int64)
    return cells.view(np.uint8)[used], ends[until_a + until_b - 1]


class Block:
    """Parts with their links, until there are enough for a block."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.names: list[tuple] = []
        self.held: list[Tokens] = []
        self.bytes = 0

    def add(self, name: tuple, tokens: Tokens, size: int) -> None:
        self.names.append(name)
        self.held.append(tokens)
        self.bytes += size

    def finish(self, hashed: bool) -> pa.RecordBatch:
        """One row of ``_BLOCK``; ``hashed``: with the hash of each part's groups."""
        tokens = Tokens(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
        ends_a, ends_b = (np.cumsum(s[t]) for s, t in zip(self.sizes, tokens, strict=True))
        n_a = np.array([len(t.a) for t in self.held])
        n_b = np.array([len(t.b) for t in self.held])
        found = align(ends_a, ends_b)
        # The links of a text are those with its tokens.
        part = np.repeat(np.arange(len(n_a)), n_a)[found.ai]
        n_links = np.bincount(part, minlength=len(n_a))
        n_groups = np.bincount(part[found.common], minlength=len(n_a))
        hashes = [""] * len(n_a)
        if hashed and len(ends_a):
            raw, ends = group_texts(tokens, found)
            view, begin, group = memoryview(raw), 0, 0
            for i, groups in enumerate(n_groups.tolist()):
                if groups:
                    group += groups
                    until = int(ends[group - 1])
                    hashes[i] = hashlib.sha256(view[begin : until - 1]).hexdigest()
                    begin = until
        pairs = tokens.a[found.ai].astype(np.int64) << np.int64(32) | tokens.b[found.bi].astype(np.int64)
        distinct, which = np.unique(pairs, return_inverse=True)
        copies = np.array([name[2] for name in self.names], np.int64)
        times = np.bincount(which, weights=copies[part], minlength=len(distinct)).astype(np.int64)
        planes = which.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        numbers = [c.tolist() for c in (n_a, n_b, n_groups, n_links)]
        keys = [f.name for f in _PART_TYPE]
        rows = [
            dict(zip(keys, (*name, *counts), strict=True))
            for name, *counts in zip(self.names, *numbers, hashes, strict=True)
        ]
        self.__init__(self.sizes)
        return batch(_BLOCK_SCHEMA, [rows], [distinct], [times], [squeeze(planes)])


def _whole_texts(paths: Paths, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(paths)
        block = Block(encoder.sizes)
        ids: list[int | None] = []
        pieces: list[list[bytes]] = []
        sizes: list[int] = []
        total = 0

        def finish() -> pa.RecordBatch:
            for doc_id, size, tokens in zip(ids, sizes, encoder.encode(pieces), strict=True):
                block.add((doc_id, None, 1), tokens if size and tokens else _NONE, size)
            for held in (ids, pieces, sizes):
                held.clear()
            return block.finish(True)

        for rows in batches:
            for doc_id, text in zip(
                rows.column("doc_id").to_pylist(), texts_of(rows.column("text")), strict=True
            ):
                ids.append(doc_id)
                pieces.append(text_pieces(text) if text else [])
                sizes.append(len(text))
                total += len(text)
                if total >= block_bytes:
                    yield finish()
                    total = 0
        if ids:
            yield finish()

    return run


def _closed_parts(paths: Paths, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(Encoder(paths).sizes)
        for rows in batches:
            for row in rows.to_pylist():
                tokens = Tokens(*(np.frombuffer(row[c], np.uint32) for c in ("a", "b")))
                block.add((row["did"], row["name"], row["copies"]), tokens, 4 * len(tokens.a))
                if block.bytes >= block_bytes:
                    yield block.finish(False)
        if block.names:
            yield block.finish(False)

    return run


def safe_places(text: bytes) -> np.ndarray:
    """Offsets of the blanks before which a text can be cut; the first byte is one."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    inner = (raw[1:-1] == 32) & ~space[:-2] & ~space[2:]
    return np.r_[0, np.flatnonzero(inner) + 1]


def text_ranges(text: bytes, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A blank and the text in byte ranges: where the body begins, where the range begins
    and ends, and the body, which is the range and the rest of the pieces it cuts.

    A range does not end inside a piece longer than ``size``: that is left in one body.
    """
    whole = b" " + text
    places = np.r_[safe_places(whole), len(whole)]
    edges = np.arange(size, len(whole), size)
    after = np.searchsorted(places, edges, side="right")
    edges = edges[places[after] - places[after - 1] <= size].tolist()
    for begin, end in zip([0, *edges], [*edges, len(whole)], strict=True):
        low = int(places[np.searchsorted(places, begin, side="right") - 1])
        high = int(places[np.searchsorted(places, end)])
        yield low, begin, end, whole[low:high]


def _cut(size: int):
    schema = _schema(_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = rows.select(["did", "name", "copies"]).to_pylist()
            for row, text in zip(names, texts_of(rows.column("text")), strict=True):
                for idx, entry in enumerate(text_ranges(text, size)):
                    yield batch(schema, *([v] for v in (*row.values(), idx, *entry)))

    return run


class Fragment(NamedTuple):
    """Tokens before the first cut, between first and last, and after the last.

    Without a cut all tokens are in ``prefix``.
    """

    cut: bool
    prefix: Tokens
    closed: Tokens
    suffix: Tokens


def fragment(
    tokens: Tokens, sizes: tuple[np.ndarray, np.ndarray], low: int, begin: int, end: int
) -> Fragment:
    """The fragment of the range of a body that begins at ``low``; a token belongs to the
    range in which it begins."""
    kept, bounds = [], []
    for ids, size in zip(tokens, sizes, strict=True):
        edge = low + np.r_[0, np.cumsum(size[ids])]
        first, until = np.searchsorted(edge, [begin, end])
        kept.append((ids[first:until], edge[first : until + 1]))
        bounds.append(edge[first : until + 1])
    cuts = np.intersect1d(*bounds, assume_unique=True)
    if not len(cuts):
        return Fragment(False, Tokens(*(ids for ids, _ in kept)), _NONE, _NONE)
    parts = []
    for ids, edge in kept:
        first, last = np.searchsorted(edge, [cuts[0], cuts[-1]])
        parts.append((ids[:first], ids[first:last], ids[last:]))
    return Fragment(True, *(Tokens(*p) for p in zip(*parts, strict=True)))


def _fragments(paths: Paths):
    schema = _schema(f"{_OPEN}, ca binary, cb binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(paths)
        for rows in batches:
            for row in rows.to_pylist():
                (tokens,) = encoder.encode([text_pieces(row["body"][1:])])
                found = Fragment(True, _NONE, _NONE, _NONE)
                if tokens is not None:
                    found = fragment(tokens, encoder.sizes, row["low"], row["begin"], row["end"])
                raw = [ids.tobytes() for part in found[1:] for ids in part]
                first = row["idx"] if found.cut else -1
                yield batch(
                    schema,
                    *([row[c]] for c in ("did", "name", "copies", "idx")),
                    *([v] for v in (first, found.cut, tokens is not None, *raw[:2], *raw[4:], *raw[2:4])),
                )

    return run


def compose(rows: Iterable[dict]) -> tuple[dict, list[dict]]:
    """The fragment of neighbouring ranges in order, and the groups closed between them.

    A group closed before the first cut of fragment ``first`` stands before its groups.
    """
    total: dict | None = None
    closed = []
    for row in rows:
        if total is None:
            total = dict(row)
            continue
        total["ok"] = total["ok"] and row["ok"]
        side = "s" if total["cut"] else "p"
        for stream in "ab":
            total[side + stream] += row["p" + stream]
        if row["cut"]:
            if total["cut"]:
                if total["sa"] or total["sb"]:
                    closed.append({"at": row["first"], "a": total["sa"], "b": total["sb"]})
            else:
                total["cut"], total["first"] = True, row["first"]
            total["sa"], total["sb"] = row["sa"], row["sb"]
    return total, closed


def _compose(fan: int):
    schema = _schema(f"{_OPEN}, a binary, b binary")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        total, closed = compose(rows)
        total["at"] //= fan
        named = {c: total[c] for c in ("did", "name", "copies")}
        return pa.Table.from_pylist([total, *({**named, **c} for c in closed)], schema)

    return run


def _hashed(paths: Paths):
    """Counts and hash of each long text, from its closed parts in order."""
    schema = _schema(_LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Encoder(paths).sizes
        current, counts, state = None, [], None

        def done() -> pa.RecordBatch:
            did, name, copies = current
            return batch(schema, *([v] for v in (did, name, copies, *counts, state.hexdigest())))

        for rows in batches:
            for row in rows.to_pylist():
                key = (row["did"], row["name"], row["copies"])
                if key != current:
                    if current is not None:
                        yield done()
                    current, counts, state = key, [0, 0, 0, 0], hashlib.sha256()
                tokens = Tokens(*(np.frombuffer(row[c], np.uint32) for c in ("a", "b")))
                if not len(tokens.a):
                    continue
                ends_a, ends_b = (np.cumsum(s[t]) for s, t in zip(sizes, tokens, strict=True))
                found = align(ends_a, ends_b)
                raw, _ = group_texts(tokens, found)
                if counts[0]:
                    state.update(b";")
                state.update(memoryview(raw)[:-1])
                n_groups = int(found.common.sum())
                more = (len(tokens.a), len(tokens.b), n_groups, len(found.ai))
                counts = [c + m for c, m in zip(counts, more, strict=True)]
        if current is not None:
            yield done()

    return run


_LONG = "did long, name string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _long_texts(
    long: DataFrame, paths: Paths, range_bytes: int, fan: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closed parts, counts with hashes, and the names of all long texts."""
    spread = long.mapInArrow(_cut(range_bytes), _RANGES).repartition("did", "name", "idx")
    fragments = materialise(
        spread.mapInArrow(_fragments(paths), f"{_OPEN}, ca binary, cb binary"), "fragments"
    )
    place = ["did", "name", "copies"]
    parts = fragments.select(
        *place, (F.col("at") * 2 + 1).alias("at"), F.col("ca").alias("a"), F.col("cb").alias("b")
    )
    state = fragments.drop("ca", "cb")
    last = state.agg(F.max("at")).first()[0] or 0
    schema = f"{_OPEN}, a binary, b binary"
    while last:
        joined = state.withColumn("up", F.expr(f"at div {fan}")).groupBy("did", "name", "up")
        step = materialise(joined.applyInArrow(_compose(fan), schema), "composed")
        between = step.filter(F.col("ok").isNull())
        parts = parts.unionByName(
            between.select(*place, (F.col("at") * 2).alias("at"), "a", "b")
        )
        state = step.filter(F.col("ok").isNotNull()).drop("a", "b")
        last //= fan
    misspelled = state.filter(~F.col("ok")).select("did", "name")
    good = lookup_join(parts, misspelled, ["did", "name"], "left_anti", computed=True)
    ordered = good.repartition("did", "name").sortWithinPartitions("did", "name", "at")
    return good, ordered.mapInArrow(_hashed(paths), _LONG), state.select(*place)


def _give():
    fields = [*_PART_TYPE, pa.field("n_best", pa.int64()), pa.field("count_sum", pa.int64())]
    schema = pa.schema(fields)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = block.column("parts").combine_chunks().flatten()
        (raw,) = unsqueeze(block.column("links")[0].as_py())
        which = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32)
        order = np.argsort(answers.column("pair").to_numpy())
        until = np.r_[0, np.cumsum(parts.field("n_links").to_numpy())]
        sums = []
        for name in ("best", "count"):
            values = answers.column(name).to_numpy()[order].astype(np.int64)
            running = np.r_[0, np.cumsum(values[which.ravel()])]
            sums.append(running[until[1:]] - running[until[:-1]])
        return pa.Table.from_batches([batch(schema, *parts.flatten(), *sums)], schema)

    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links hold an id pair, and whether no other pair of its
    B id is held by more.  ``pair`` is the A id times 2^32 plus the B id."""
    # A B id pairs with the ids of A's vocabulary and no more.
    same = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(int(_LOW))))
    return (
        blocks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
        .toDF("pair", "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("count"))
        .withColumn("best", (F.col("count") == F.max("count").over(same)).cast("int"))
    )


def aligned_tokens(
    docs: DataFrame,
    paths: Paths,
    range_bytes: int = RANGE_BYTES,
    block_bytes: int = BLOCK_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is its B id's most frequent one in all documents,
    ``count_sum`` adds up the corpus' counts of the links' pairs.  ``groups_sha256`` is the
    hash of the groups as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that the tokens of either tokenizer do not spell,
    have no tokens: zeros and an empty hash.  Repeated rows count as often as they are there,
    null doc_ids stay null, an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > range_bytes
    blocks = source.filter(~is_long).mapInArrow(_whole_texts(paths, block_bytes), _BLOCK)
    # Equal rows are cut and aligned once.
    long = (
        source.filter(is_long)
        .groupBy(F.col("doc_id").alias("did"), "text")
        .agg(F.count("*").alias("copies"))
        .select("did", F.sha2("text", 256).alias("name"), "copies", "text")
    )
    parts, hashed, names = _long_texts(long, paths, range_bytes, fan)
    closed = parts.select("did", "name", "copies", "a", "b")
    blocks = blocks.unionByName(closed.mapInArrow(_closed_parts(paths, block_bytes), _BLOCK))
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "link-blocks")
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(blocks), "pair")
    given = (
        blocks.select("block", "parts", "links")
        .groupBy("block")
        .cogroup(answers.groupBy("of"))
        .applyInArrow(_give(), f"{_PART}, n_best long, count_sum long")
    )
    given = materialise(given, "links")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    sums = (
        given.filter(F.col("name").isNotNull())
        .groupBy(F.col("doc_id").alias("did"), "name")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    same_text = [F.col("x.did").eqNullSafe(F.col("y.did")), F.col("x.name") == F.col("y.name")]
    counted = hashed.drop("copies").alias("x").join(sums.alias("y"), same_text).select("x.*", "n_best", "count_sum")
    whole = names.alias("x").join(counted.alias("y"), same_text, "left").select(
        F.col("x.did").alias("doc_id"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
        *[F.coalesce(F.col(f"y.{c}"), F.lit(0)).alias(c) for c in columns[1:-1]],
        F.coalesce("y.groups_sha256", F.lit("")).alias("groups_sha256"),
    )
    return given.filter(F.col("name").isNull()).select(*columns).unionByName(whole.select(*columns))
