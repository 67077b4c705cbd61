"""Near duplicates by an inverted join over MinHash signature coordinates.

A document is its set of distinct word shingles, and its signature the minimum of
the set under ``COORDINATES`` hash functions.  Documents are posted under
(coordinate, value); two documents are candidates if at least ``MATCHES`` coordinates
agree.  Sets of similarity 0.8 agree in 38 of 48 on average, and in fewer than 24
with a chance of about 2 in 10 million.  All documents order their coordinate-value
pairs alike, rare ones first, and a pair of documents with that many agreements has one
among the first ``PREFIX`` of each.  Only those are posted, and the others are skipped:
they are counted where the posting is read, from four bits each, which adds to the count
and takes nothing off it.  The order decides how
long lists are and not what is found, so it rests on counts of the ``MOST_COMMON`` most
frequent pairs only, and on hashes for the rest.

Equal sets are one entry.  A posting list is not paired out: its first document is a
hub for those that match it, the first of the rest is the next hub, and so on, which
gives fewer candidates than the list has entries.  What candidates connect is a
family; lists that hold documents of several families are read again for matches
across them, so that every candidate pair ends up inside one family.

The texts of a family meet once, in blocks of ``BLOCK`` documents, every two blocks
in a task of their own.  There the full sets are compared by counting common elements
in matrix products, and of the confirmed links only those that join something not yet
joined are given.  Components of these links are the result.

A list that needs more than ``MOST_HUBS`` hubs holds mostly strangers.  It is posted
again under a second coordinate, by the same rule of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.anchors import bodies_of, mixed
from cinerank.llm.common import NO_ID, batch, keyed, real_id, texts_of
from cinerank.llm.components import components
from cinerank.operators.skew import lookup_join, materialise_measured, sized_join
from cinerank.session import materialise

COORDINATES, MATCHES = 48, 24
PREFIX = COORDINATES - MATCHES + 1
# Pairs whose counts order the postings, and documents that are counted together.
MOST_COMMON, COUNTED_ROWS = 100_000, 10_000
# Posting a list again takes as long as comparing about twice as many hubs as this.
MOST_HUBS = 24_000
LEVELS = 2
# Documents of a family that are compared together; two blocks meet in one task.
BLOCK = 1024
# Lists of up to so many rows are compared together, in portions of about so many rows.
SHORT_LIST, LISTED_ROWS = 64, 1 << 16
# Elements per matrix product.
_COLUMNS = 2048
SIMILAR = 80  # percent
_ROWS = 1024  # rows of a posting list compared at once
_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, COORDINATES, np.uint64)

PAIR, MEMBER, CROWDED = 0, 1, 2
_FOUND = "kind int, key long, used long, did long, tk long, to_did long, to_tk long"
_FOUND_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.int64()),
        ("used", pa.int64()),
        ("did", pa.int64()),
        ("tk", pa.int64()),
        ("to_did", pa.int64()),
        ("to_tk", pa.int64()),
    ]
)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words, A-Z in lower case.

    A text of fewer words is one shingle, one without words none.
    """
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    size = min(words, len(hashed))
    total = np.full(len(hashed) - size + 1, np.uint64(size))
    for i in range(size):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - size + 1 + i])
    return np.unique(total)


def signature(members: np.ndarray) -> np.ndarray:
    """Minimum of the set under each hash function."""
    best = np.full(COORDINATES, np.uint64((1 << 64) - 1))
    for i in range(0, len(members), 2048):
        part = (members[i : i + 2048, None] ^ _MASKS) * _FACTORS
        best = np.minimum(best, part.min(axis=0))
    return best


def _entries(words: int):
    schema = pa.schema(
        [("did", pa.int64()), ("tk", pa.int64()), ("n", pa.int64())]
        + [("g1", pa.int64()), ("g2", pa.int64()), ("signature", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, first, second, signatures = [], [], [], []
            for text in texts_of(rows.column("text")):
                members = shingles(text, words)
                sizes.append(len(members))
                first.append(int(mixed(members).sum(dtype=np.uint64)))
                second.append(int(mixed(members ^ _MASKS[0]).sum(dtype=np.uint64)))
                signatures.append(mixed(signature(members)).tobytes())
            yield batch(
                schema,
                rows.column("did"),
                rows.column("tk"),
                sizes,
                np.array(first, np.uint64).view(np.int64),
                np.array(second, np.uint64).view(np.int64),
                signatures,
            )

    return run


def _pairs_of(values: np.ndarray) -> np.ndarray:
    """64 bits of hash of each coordinate with its value."""
    return mixed(values + np.uint64(1) + np.arange(COORDINATES, dtype=np.uint64))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, COORDINATES)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that occur three times and more among some thousand documents."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, counts = np.unique(_pairs_of(np.concatenate(held)), return_counts=True)
        return batch(schema, pairs[counts > 2].view(np.int64), counts[counts > 2])

    held: list[np.ndarray] = []
    for rows in batches:
        held.append(_signatures(rows.column("signature")))
        if sum(map(len, held)) >= COUNTED_ROWS:
            yield counted(held)
            held = []
    if held:
        yield counted(held)


def common_pairs(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Most frequent pairs, sorted, and how often they were seen: a table of bounded size."""
    rows = (
        entries.select("signature")
        .mapInArrow(_count_pairs, "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pair")
        .limit(MOST_COMMON)
        .toPandas()
    )
    pairs = rows["pair"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(pairs)
    return pairs[order], rows["n"].to_numpy(np.int64)[order]


def _ranks(pairs: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each pair in the order of all documents: by count, then by hash."""
    known, counts = common
    # Counts in steps of about an eighth leave room for the bits of the hash.
    step = np.zeros(pairs.shape, np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        steps = np.floor(8 * np.log2(counts)).astype(np.uint64) + np.uint64(1)
        step = np.where(known[at] == pairs, steps[at], np.uint64(0))
    return (step << np.uint64(52)) | (pairs >> np.uint64(12))


def _post(shared):
    """A row per posting.  ``used`` has a bit for each coordinate that led to ``key``."""
    schema = pa.schema(
        [("key", pa.int64()), ("used", pa.int64()), ("did", pa.int64()), ("tk", pa.int64())]
        + [("brief", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for begin in range(0, rows.num_rows, _ROWS):
                part = rows.slice(begin, _ROWS)
                values = _signatures(part.column("signature"))
                key = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                used = part.column("used").to_numpy(zero_copy_only=False)
                taken = (used[:, None] >> np.arange(COORDINATES)) & 1 == 1
                pairs = _pairs_of(values)
                ranks = np.where(taken, np.uint64((1 << 64) - 1), _ranks(pairs, shared.value))
                coordinate = np.sort(np.argpartition(ranks, PREFIX, axis=1)[:, :PREFIX], axis=1)
                # A coordinate that was posted before is none of the first ones.
                row, place = np.nonzero(~np.take_along_axis(taken, coordinate, axis=1))
                coordinate = coordinate[row, place]
                brief = [v.tobytes() for v in _brief(values)]
                yield batch(
                    schema,
                    mixed(pairs[row, coordinate] ^ key[row]).view(np.int64),
                    used[row] | (np.int64(1) << coordinate.astype(np.int64)),
                    part.column("did").to_numpy()[row],
                    part.column("tk").to_numpy()[row],
                    [brief[i] for i in row],
                )

    return run


def _brief(values: np.ndarray) -> np.ndarray:
    """Four bits of each value, two values in a byte."""
    low = (values & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def _briefs(column: pa.Array, width: int = COORDINATES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).sum(axis=1) >= MATCHES


def _agree_by_halves(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    apart = many ^ one
    return ((apart & 15) == 0).sum(axis=1) + ((apart >> 4) == 0).sum(axis=1) >= MATCHES


def _slices(rows: pa.RecordBatch) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of a sorted batch with one key each, and whether a part begins a key."""
    key = rows.column("key").to_numpy()
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        for at in range(begin, end, _ROWS):
            yield at == begin, rows.slice(at, min(_ROWS, end - at))


class _List:
    """One posting list, read in parts; keeps its hubs only."""

    def __init__(self, key: int, used: int, most: int):
        self.key, self.used, self.most = key, used, most
        self.hubs: list[tuple[int, int, np.ndarray]] = []
        self.size = 0
        self.waiting: list[tuple[int, int]] = []

    def add(self, did: list[int], tk: list[int], briefs: np.ndarray) -> Iterator[tuple]:
        """Pairs with hubs; members, once there are three."""
        left = np.arange(len(did))
        at = 0
        while len(left) and len(self.hubs) <= self.most:
            if at == len(self.hubs):
                first = left[0]
                self.hubs.append((did[first], tk[first], briefs[first]))
                left = left[1:]
                at += 1
                hub = self.hubs[-1]
            else:
                hub = self.hubs[at]
                at += 1
            near = _agree_by_halves(hub[2], briefs[left])
            for i in left[near].tolist():
                yield PAIR, 0, 0, hub[0], hub[1], did[i], tk[i]
            left = left[~near]
        self.size += len(did)
        self.waiting.extend(zip(did, tk, strict=True))
        if self.size > 2:
            for d, t in self.waiting:
                yield MEMBER, self.key, self.used, d, t, d, t
            self.waiting = []

    def close(self) -> Iterator[tuple]:
        if len(self.hubs) > self.most:
            yield CROWDED, self.key, self.used, 0, 0, 0, 0


def _stars(most: int):
    """Candidates of lists that come sorted by key, did, tk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _List | None = None
        for rows in batches:
            out: list[tuple] = []
            key = rows.column("key").to_numpy()
            alone = np.ones(len(key), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            if len(key):
                # The ends may go on in other batches.
                alone[-1] = False
                alone[0] = current is not None and current.key != key[0] and alone[0]
                rows = rows.filter(pa.array(~alone))
            for _, part in _slices(rows) if rows.num_rows else ():
                name = part.column("key")[0].as_py()
                if current is None or current.key != name:
                    if current is not None:
                        out.extend(current.close())
                    current = _List(name, part.column("used")[0].as_py(), most)
                ids = part.column("did").to_pylist(), part.column("tk").to_pylist()
                out.extend(current.add(*ids, _briefs(part.column("brief"), COORDINATES // 2)))
            if out:
                yield batch(_FOUND_SCHEMA, *zip(*out, strict=True))
        if current is not None and (rest := list(current.close())):
            yield batch(_FOUND_SCHEMA, *zip(*rest, strict=True))

    return run


def _joining(root: np.ndarray, briefs: np.ndarray) -> list[tuple[int, int]]:
    """Matches within one list that join families not joined by an earlier match."""
    root = np.unique(root, return_inverse=True)[1]
    found = []
    for i in range(len(root) - 1):
        near = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        for j in near[_agree(briefs[i], briefs[near])].tolist():
            if root[j] != root[i]:
                found.append((i, j))
                # From here on they are one family.
                root[root == root[j]] = root[i]
    return found


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches that join different families within lists that come sorted by key.

    Short lists are compared all at once, each row with the first, second, ... after
    it; long ones one by one.
    """
    schema = pa.schema(_FOUND_SCHEMA.field(i) for i in (3, 4, 5, 6))

    def matches(rows: pa.Table) -> pa.RecordBatch:
        key, did, tk, root = (rows.column(n).to_numpy() for n in ("key", "did", "tk", "root"))
        briefs = _briefs(rows.column("brief").combine_chunks())
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        left = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1
        short = np.repeat(sizes <= SHORT_LIST, sizes)
        found = []
        for step in range(1, int(sizes[sizes <= SHORT_LIST].max(initial=1))):
            i = np.flatnonzero(short & (left >= step))
            i = i[root[i] != root[i + step]]
            near = _agree(briefs[i], briefs[i + step])
            found.append(np.c_[i[near], i[near] + step])
        for begin, size in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
            joined = _joining(root[begin : begin + size], briefs[begin : begin + size])
            found.append(np.array(joined, np.int64).reshape(-1, 2) + begin)
        i, j = np.concatenate([np.zeros((0, 2), np.int64), *found]).T
        return batch(schema, did[i], tk[i], did[j], tk[j])

    held: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        held.append(rows)
        if sum(h.num_rows for h in held) < LISTED_ROWS:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        # The last list may go on.
        cut = int(np.argmax(key == key[-1]))
        if cut:
            yield matches(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield matches(pa.Table.from_batches(held))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets.

    Elements of many sets are counted by matrix products, the others pair by pair,
    and those of a single set not at all.
    """
    n = len(sets)
    common = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    sizes = np.diff(np.r_[starts, len(values)])
    many = sizes > max(2, n // 16)
    for begin in range(0, int(many.sum()), _COLUMNS):
        chosen = np.flatnonzero(many)[begin : begin + _COLUMNS]
        column = np.repeat(np.arange(len(chosen)), sizes[chosen])
        place = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in chosen])
        held = np.zeros((n, len(chosen)), np.float32)
        held[owner[place], column] = 1
        common += held @ held.T
    few = np.flatnonzero(~many & (sizes > 1))
    for size in np.unique(sizes[few]):
        at = starts[few[sizes[few] == size]]
        for i in range(size):
            for j in range(size):
                if i != j:
                    np.add.at(common, (owner[at + i], owner[at + j]), 1)
    return common


def spanning_links(sets: list[np.ndarray], side: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """Links that join what similar sets connect; ``across``: of different sides only."""
    size = np.array([len(x) for x in sets], np.float64)
    near = (100 + SIMILAR) * common_counts(sets) >= SIMILAR * (size[:, None] + size[None, :])
    np.fill_diagonal(near, False)
    if across:
        near &= side[:, None] != side[None, :]
    found = []
    fresh = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root] = False
        frontier = [root]
        while frontier:
            one = frontier.pop()
            reached = np.flatnonzero(near[one] & fresh)
            fresh[reached] = False
            found.extend((one, other) for other in reached.tolist())
            frontier.extend(reached.tolist())
    return found


def _link(words: int):
    """Links within families that come sorted by family and pair of blocks."""
    schema = pa.schema(_FOUND_SCHEMA.field(i) for i in (3, 4, 5, 6))

    def linked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        did, tk, side = (rows.column(n).to_numpy() for n in ("did", "tk", "block"))
        # A row that is repeated as it is counts once.
        _, once = np.unique(np.stack([did, tk]), axis=1, return_index=True)
        rows, did, tk, side = rows.take(pa.array(once)), did[once], tk[once], side[once]
        sets = [shingles(b, words) for b in bodies_of(rows.column("body"))]
        across = rows.column("low")[0] != rows.column("high")[0]
        found = spanning_links(sets, side, across)
        if found:
            u, v = np.array(found).T
            yield batch(schema, did[u], tk[u], did[v], tk[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for rows in batches:
            if not rows.num_rows:
                continue
            key = np.stack([rows.column(n).to_numpy() for n in ("family", "low", "high")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), rows.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                name = tuple(key[:, begin].tolist())
                if parts and name != current:
                    yield from linked(parts)
                    parts = []
                current = name
                parts.append(rows.slice(begin, end - begin))
        if parts:
            yield from linked(parts)

    return run


def _links(docs: DataFrame, families: DataFrame, words: int) -> DataFrame:
    """Confirmed links (did, tk, to_did, to_tk) within families (did, tk, family)."""
    sizes = families.groupBy("family").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    placed = families.join(sizes, "family").select(
        "did",
        "tk",
        "family",
        F.pmod(F.xxhash64("did", "tk"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    placed, size = materialise_measured(placed, "placed")
    # Only texts of families move.
    return (
        sized_join(keyed(docs), placed, ["did", "tk"], size)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other")
        .mapInArrow(_pressed, _PLACED)
        .repartition("family", "low", "high")
        .sortWithinPartitions("family", "low", "high", "did", "tk")
        .mapInArrow(_link(words), "did long, tk long, to_did long, to_tk long")
    )


_PLACED = "did long, tk long, family long, block int, low int, high int, body binary"


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        bodies = pa.array([press.compress(t) for t in texts_of(rows.column("text"))], pa.binary())
        names = [field.split(" ")[0] for field in _PLACED.split(", ")]
        columns = [rows.column(name) for name in names[:-1]]
        yield pa.RecordBatch.from_arrays([*columns, bodies], names=names)


def _node(did: str = "did", tk: str = "tk") -> Column:
    return F.struct(F.col(did).alias("did"), F.col(tk).alias("tk"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(_node().alias("u"), _node("to_did", "to_tk").alias("v"))


def _candidates(entries: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs with hubs and members of lists, of all levels of posting."""
    pairs, members = [], []
    posting = entries.select(
        F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"), "did", "tk", "signature"
    )
    shared = entries.sparkSession.sparkContext.broadcast(common_pairs(entries))
    # Posting again multiplies entries by PREFIX, so the last level takes lists as they are.
    for level in range(LEVELS):
        found = materialise(
            posting.mapInArrow(_post(shared), "key long, used long, did long, tk long, brief binary")
            .repartition("key")
            .sortWithinPartitions("key", "did", "tk")
            .mapInArrow(_stars(most if level < LEVELS - 1 else 1 << 62), _FOUND),
            "candidates",
        )
        pairs.append(found.filter(F.col("kind") == PAIR))
        crowded = found.filter(F.col("kind") == CROWDED).select("key")
        held = found.filter(F.col("kind") == MEMBER).select("key", "used", "did", "tk")
        if crowded.isEmpty():
            members.append(held)
            break
        members.append(held.join(crowded, "key", "left_anti"))
        posting = held.join(crowded, "key", "left_semi").join(
            entries.select("did", "tk", "signature"), ["did", "tk"]
        )
    return pairs, members


def _all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def near_duplicates(docs: DataFrame, words: int = 5, most_hubs: int = MOST_HUBS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, tk, stands.

    Documents are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of 0.8 or more; a component is what links connect, and its smallest
    doc_id names and stays for it.  A document without words or text is linked with
    nothing.  A null doc_id stands for its component only if no other id does, which
    is then null.  Rows with one doc_id and different texts are documents of their
    own; a repeated row is marked as its twin is.  ``stands`` marks one (doc_id, tk) of
    each component, where ``kept`` marks every text under the id that stays.
    """
    rows = materialise(
        keyed(docs).mapInArrow(
            _entries(words),
            "did long, tk long, n long, g1 long, g2 long, signature binary",
        ),
        "entries",
    )
    groups = materialise(
        rows.filter("n > 0")
        .groupBy("g1", "g2")
        .agg(F.min(F.struct("did", "tk", "signature")).alias("first"), _least_id().alias("least"), F.min(_standing()).alias("stand"))
        .select("g1", "g2", "first.did", "first.tk", "first.signature", "least", "stand"),
        "groups",
    )
    pairs, members = _candidates(groups, most_hubs)
    tried = _edges(_all(pairs).select("did", "tk", "to_did", "to_tk").distinct())
    families = components(tried)

    labelled = _all(members).join(
        families.select("node.did", "node.tk", "root"), ["did", "tk"], "left"
    )
    labelled = labelled.withColumn("root", F.xxhash64(F.coalesce("root", _node())))
    several = (
        labelled.groupBy("key")
        .agg(F.min("root").alias("a"), F.max("root").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("key")
    )
    brief = groups.select("did", "tk", "signature").mapInArrow(
        _shorten, "did long, tk long, brief binary"
    )
    across = materialise(
        labelled.join(several, "key", "left_semi")
        .join(brief, ["did", "tk"])
        .select("key", "did", "tk", "root", "brief")
        .repartition("key")
        .sortWithinPartitions("key", "did", "tk")
        .mapInArrow(_across, "did long, tk long, to_did long, to_tk long")
        .distinct(),
        "across",
    )
    if not across.isEmpty():
        trees = families.select(F.col("node").alias("u"), F.col("root").alias("v"))
        families = components(trees.unionByName(_edges(across)))
    named = families.select("node.did", "node.tk", F.xxhash64("root").alias("family"))
    links = _links(docs, named, words)
    roots = materialise(components(_edges(links)), "roots")

    # The smallest real id of each component, over all of its groups.
    named = groups.join(roots.select("node.did", "node.tk", "root"), ["did", "tk"], "left")
    named = named.withColumn("root", F.coalesce("root", _node()))
    least = named.groupBy("root").agg(
        F.min("least").alias("component"), F.min("stand").alias("stand")
    )
    by_group = named.drop("stand").join(least, "root").select("g1", "g2", "component", "stand")
    # Texts without words have one key, and nothing to look up.
    worded = lookup_join(rows.filter("n > 0"), by_group, ["g1", "g2"], computed=True).select(
        real_id().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        real_id().eqNullSafe(F.col("component")).alias("kept"),
        "tk",
        (_standing() == F.col("stand")).alias("stands"),
    )
    wordless = rows.filter("n = 0").select(
        real_id().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real_id().alias("component_id"),
        F.lit(True).alias("kept"),
        "tk",
        F.lit(True).alias("stands"),
    )
    return worded.unionByName(wordless)


def _standing() -> Column:
    """Orders documents by who stands for the others: a real id before none."""
    return F.struct((F.col("did") == NO_ID).alias("unnamed"), "did", "tk")


def _least_id() -> Column:
    return F.min(F.when(F.col("did") != NO_ID, F.col("did")))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("did", pa.int64()), ("tk", pa.int64()), ("brief", pa.binary())])
    for rows in batches:
        briefs = [v.tobytes() for v in _signatures(rows.column("signature")).astype(np.uint8)]
        yield batch(schema, rows.column("did"), rows.column("tk"), briefs)
