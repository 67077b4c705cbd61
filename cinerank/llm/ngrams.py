"""Scoring texts with a bigram model held in Elias-Fano tries.

Every block of documents (see ``blocks``) asks for the counts of its distinct words
and for the weights of its distinct word pairs.  Words and the pairs they begin meet
by shard of the word.  A shard adds up the training counts of all blocks and builds a
trie: sorted word hashes, a monotone pointer from each to its successors in
Elias-Fano form, successor hashes sorted within their context, and smoothed
probabilities quantised to a byte, all in one memory-mapped file that lives as long
as its task.  The trie has one level.  For each pair that a block asks for, the two
pointers of its context are selected from the Elias-Fano bits and the successor is
searched between them, in the mapped file; nothing is unpacked but what is compared.

Successors of the commonest words (more than one in ``HOT_SHARE`` tokens, so at most
``HOT_SHARE`` words) and of the beginning of a text are dealt over all shards.  How
many distinct ones such a word has is the sum over the shards: every block asks
every shard, and adds up.

Smoothing is absolute discounting, interpolated with word probabilities whose unknown
word has the share of words seen once.  Words are known by 64 bits of hash, and by 40
of them within a context.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.anchors import mixed
from cinerank.llm.blocks import (
    ANSWERED_SCHEMA,
    ASKED_SCHEMA,
    BLOCK_BYTES,
    ask_and_answer,
    blocks,
    squeeze,
    texts,
    unsqueeze,
)
from cinerank.llm.common import batch, crc_slot, texts_of
from cinerank.session import materialise

FOLDS, HELD_FOLD = 5, 1
DISCOUNT = 0.75
# Pairs take more room than words, so blocks are half as large as usual.
LM_BLOCK_BYTES = BLOCK_BYTES // 2
HOT_SHARE = 1000
END, BEGIN = np.uint64(1), np.uint64(2)
# Weights are powers of ten from -9 to 0 in 255 steps; 0 stands for none.
STEP = 9 / 254
_CUT = np.uint64(24)  # a successor is known by its leading 40 bits
_LOW = (1 << 40) - 1


def quantise(weights: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        levels = np.rint(np.log10(weights) / STEP) + 255
    return np.where(weights > 0, np.clip(levels, 1, 255), 0).astype(np.uint8)


# Bytes of unary bits between two entries of the directory.
RUN = 32
# Where the n-th one of a byte stands, from its highest bit.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
ONE_IN_BYTE = (_BITS.cumsum(axis=1)[:, None, :] == np.arange(1, 9)[None, :, None]).argmax(axis=2)
WEIGHT = np.r_[0.0, 10.0 ** ((np.arange(1, 256) - 255) * STEP)]


@dataclass(frozen=True)
class Totals:
    """Of the training tokens: how many, how many distinct, how many seen once; hot words."""

    tokens: int
    distinct: int
    once: int
    documents: int
    hot: dict[int, int]

    @property
    def unknown(self) -> float:
        return (self.once + 1) / (self.tokens + 1 + (self.once == self.tokens))


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, and a directory of
    how many ones stand before each ``RUN`` bytes of the unary part."""

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.size, self.bits, self.low, self.high, self.before = size, bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        unary = np.zeros(n + (most >> bits) + 1, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        high = np.packbits(unary)
        high = np.pad(high, (0, -len(high) % RUN))
        ones = np.bitwise_count(high).reshape(-1, RUN).sum(axis=1, dtype=np.int64)
        return cls(n, bits, np.packbits(low.ravel()), high, np.cumsum(ones) - ones)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The values numbered ``index``: each one selected by itself, nothing else unpacked."""
        run = np.searchsorted(self.before, index, "right") - 1
        rest = index - self.before[run]
        held = self.high.reshape(-1, RUN)[run]
        ones = np.bitwise_count(held).cumsum(axis=1, dtype=np.int64)
        byte = (ones <= rest[:, None]).sum(axis=1)
        each = np.arange(len(index))
        own = held[each, byte]
        nth = rest - (ones[each, byte] - np.bitwise_count(own))
        value = ((run * RUN + byte) * 8 + ONE_IN_BYTE[own, nth] - index) << self.bits
        for bit in range(self.bits):
            place = index * self.bits + bit
            value |= ((self.low[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(np.int64) << bit
        return value

    def values(self) -> np.ndarray:
        return self.at(np.arange(self.size))


class Trie:
    """Successors of contexts 0..n-1 and their quantised weights, in a memory-mapped file."""

    def __init__(self, contexts: int, composite: np.ndarray, codes: np.ndarray):
        context = composite >> 40
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        self.pointers = EliasFano.of(pointers.astype(np.int64))
        successors = (composite & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        # Successors are read eight bytes at a time, of which five count.
        padded = np.pad(successors.ravel(), (0, 8))
        parts = [self.pointers.before, self.pointers.low, self.pointers.high, padded, codes]
        # Deleted with its last use; never seen by another task.
        with tempfile.TemporaryFile() as file:
            for part in parts:
                file.write(part.tobytes())
            file.flush()
            level = np.memmap(file, np.uint8, "r", shape=(sum(p.nbytes for p in parts),))
        ends = np.cumsum([0, *(p.nbytes for p in parts)])
        before, self.pointers.low, self.pointers.high, padded, self.codes = (
            level[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)
        )
        self.pointers.before = before.view(np.int64)
        self._successors = np.ndarray((len(codes),), "<u8", padded, strides=(5,))

    def _successor(self, at: np.ndarray) -> np.ndarray:
        return (self._successors[at] & np.uint64(_LOW)).astype(np.int64)

    def weights(self, queries: np.ndarray) -> np.ndarray:
        """Codes of (context << 40 | successor); 0 where the context lacks the successor.

        A context's two pointers bound its successors, and only these are searched.
        """
        if not len(self.codes):
            return np.zeros(len(queries), np.uint8)
        context, wanted = queries >> 40, queries & _LOW
        asked, place = np.unique(context, return_inverse=True)
        low, end = self.pointers.at(asked)[place], self.pointers.at(asked + 1)[place]
        high = end.copy()
        searched = np.flatnonzero(low < high)
        while len(searched):
            middle = (low[searched] + high[searched]) >> 1
            less = self._successor(middle) < wanted[searched]
            low[searched[less]] = middle[less] + 1
            high[searched[~less]] = middle[~less]
            searched = searched[low[searched] < high[searched]]
        found = np.zeros(len(queries), np.uint8)
        inside = np.flatnonzero(low < end)
        held = inside[self._successor(low[inside]) == wanted[inside]]
        found[held] = self.codes[low[held]]
        return found


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case; 1 and 2 are kept for its ends."""
    words = text.lower().split()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.maximum(hashed, np.uint64(3))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    for rows in batches:
        found = [word_hashes(text) for text in texts_of(rows.column("text"))]
        if not found:
            continue
        word, n = np.unique(np.concatenate(found), return_counts=True)
        word, n = np.r_[END, word], np.r_[len(found), n]
        yield batch(schema, word.view(np.int64), n)


def totals(docs: DataFrame) -> Totals:
    """Counts of all training tokens, added up per batch and then by word."""
    counts = materialise(
        docs.filter(crc_slot(FOLDS) != HELD_FOLD)
        .select("text")
        .mapInArrow(_count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    tokens, distinct, once = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count("*"),
        F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)),
    ).first()
    common = counts.filter((F.col("n") > tokens / HOT_SHARE) | (F.col("word") == int(END)))
    found = {row["word"] & ((1 << 64) - 1): row["n"] for row in common.collect()}
    documents = found.get(int(END), 0)
    hot = {w: n for w, n in found.items() if w != int(END)} | {int(BEGIN): documents}
    return Totals(tokens, distinct, once, documents, dict(sorted(hot.items())))


class _Tally:
    """The distinct words and pairs of a block, and where each is asked."""

    def __init__(self, table: pa.Table, shards: int, model: Totals):
        found = [word_hashes(text.encode()) for text in texts(table)]
        self.sizes = np.array([len(f) + 1 for f in found])
        train = np.repeat(table.column("tag").to_numpy() == 1, self.sizes)
        words = np.concatenate([x for f in found for x in (f, [END])]).astype(np.uint64)
        before = np.concatenate([x for f in found for x in ([BEGIN], f)]).astype(np.uint64)
        self.vocabulary, place = np.unique(np.r_[words, before], return_inverse=True)
        self.word, context = place[: len(words)], place[len(words) :]
        n = len(self.vocabulary)
        self.counts = np.bincount(self.word[train], minlength=n)
        pairs, self.pair = np.unique(context * n + self.word, return_inverse=True)
        self.pair_counts = np.bincount(self.pair[train], minlength=len(pairs))
        self.context, self.successor = pairs // n, self.vocabulary[pairs % n] >> _CUT
        hot = np.array(list(model.hot), np.uint64)
        at = np.minimum(np.searchsorted(hot, self.vocabulary), len(hot) - 1)
        self.hot = np.where(hot[at] == self.vocabulary, at, -1)
        count = np.uint64(shards)
        self.word_shard = (mixed(self.vocabulary) % count).astype(np.int64)
        spread = mixed(mixed(self.vocabulary[self.context]) ^ mixed(self.vocabulary[pairs % n]))
        is_hot = self.hot[self.context] >= 0
        self.pair_shard = np.where(
            is_hot, (spread % count).astype(np.int64), self.word_shard[self.context]
        )
        # Within a shard: words in order, usual pairs by context, then pairs of hot contexts.
        self.by_word = np.argsort(self.word_shard, kind="stable")
        self.by_pair = np.lexsort((np.arange(len(pairs)), is_hot, self.pair_shard))
        self.is_hot = is_hot
        self.shards = shards

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """shard, its words, its usual pairs, its hot pairs."""
        w = np.searchsorted(self.word_shard[self.by_word], np.arange(self.shards + 1))
        p = np.searchsorted(self.pair_shard[self.by_pair], np.arange(self.shards + 1))
        for shard in range(self.shards):
            words = self.by_word[w[shard] : w[shard + 1]]
            pairs = self.by_pair[p[shard] : p[shard + 1]]
            # Every shard is asked: each has a part of the hot words' successors to tell.
            hot = self.is_hot[pairs]
            yield shard, words, pairs[~hot], pairs[hot]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, bytes of equal weight side by side."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :width].T).tobytes()


def _numbers(planes: bytes, width: int) -> np.ndarray:
    narrow = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return wide.ravel().view("<u8").astype(np.int64)


def _ask(shards: int, model: Totals):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        tally = _Tally(table, shards, model)
        rows = []
        for shard, words, usual, hot in tally.parts():
            followers = np.bincount(
                np.searchsorted(words, tally.context[usual]), minlength=len(words)
            )
            keys = squeeze(
                tally.vocabulary[words],
                _planes(tally.counts[words], 4),
                _planes(followers, 4),
                _planes(tally.successor[usual], 5),
                _planes(tally.pair_counts[usual], 4),
                _planes(tally.hot[tally.context[hot]], 2),
                _planes(tally.successor[hot], 5),
                _planes(tally.pair_counts[hot], 4),
            )
            rows.append({"block": block, "shard": shard, "keys": keys})
        return pa.Table.from_pylist(rows, ASKED_SCHEMA)

    return run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def unseen(kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Code of what discounting leaves to the successors that a context has not had."""
    return quantise(np.where(kinds > 0, np.minimum(DISCOUNT * kinds / total, 1.0), 1.0))


def _answer(model: Totals):
    hot_counts = np.array(list(model.hot.values()), np.int64)

    def run(table: pa.Table) -> pa.Table:
        asked = []
        for keys in table.column("keys"):
            raw = unsqueeze(keys.as_py())
            widths = (4, 4, 5, 4, 2, 5, 4)
            numbers = [_numbers(r, w) for r, w in zip(raw[1:], widths, strict=True)]
            asked.append((np.frombuffer(raw[0], np.uint64), *numbers))
        words, counts = _sums(
            np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
        )
        n = len(words)
        queries = []
        for word, _, followers, successor, _, hot, hot_successor, _ in asked:
            context = np.repeat(np.searchsorted(words, word), followers)
            queries.append(np.r_[(context << 40) | successor, ((n + hot) << 40) | hot_successor])
        pairs, pair_counts = _sums(
            np.concatenate(queries), np.concatenate([np.r_[a[4], a[7]] for a in asked])
        )
        pairs, pair_counts = pairs[pair_counts > 0], pair_counts[pair_counts > 0]
        context = pairs >> 40
        contexts = n + len(hot_counts)
        total = np.bincount(context, pair_counts, contexts)
        kinds = np.bincount(context, minlength=contexts)
        total[n:] = hot_counts
        total = np.maximum(total, 1)
        trie = Trie(contexts, pairs, quantise((pair_counts - DISCOUNT) / total[context]))
        left = unseen(kinds[:n], total[:n])
        # No pair is in two shards, so a block adds up what they have of a hot word.
        hot_kinds = _planes(kinds[n:], 5)
        rows = []
        for block, (word, *_), query in zip(table.column("block"), asked, queries, strict=True):
            at = np.searchsorted(words, word)
            answers = squeeze(
                _planes(counts[at], 6), left[at], hot_kinds, trie.weights(query)
            )
            shard = table.column("shard")[0].as_py()
            rows.append({"block": block.as_py(), "shard": shard, "answers": answers})
        return pa.Table.from_pylist(rows, ANSWERED_SCHEMA)

    return run


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("tag", pa.int32()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def _give(shards: int, model: Totals):
    hot_counts = np.array(list(model.hot.values()), np.int64)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        tally = _Tally(table, shards, model)
        counts = np.zeros(len(tally.vocabulary), np.int64)
        left = np.zeros(len(tally.vocabulary))
        seen = np.zeros(len(tally.context))
        pair_left = np.zeros(len(tally.context))
        by_shard = dict(
            zip(answers.column("shard").to_pylist(), answers.column("answers"), strict=True)
        )
        hot_kinds = np.zeros(len(hot_counts), np.int64)
        usual_pairs = []
        for shard, words, usual, hot in tally.parts():
            number, mine, kinds, codes = unsqueeze(by_shard[shard].as_py())
            counts[words] = _numbers(number, 6)
            left[words] = WEIGHT[np.frombuffer(mine, np.uint8)]
            seen[np.r_[usual, hot]] = WEIGHT[np.frombuffer(codes, np.uint8)]
            hot_kinds += _numbers(kinds, 5)
            usual_pairs.append(usual)
        usual = np.concatenate(usual_pairs)
        hot_left = WEIGHT[unseen(hot_kinds, np.maximum(hot_counts, 1))]
        pair_left[tally.is_hot] = hot_left[tally.hot[tally.context[tally.is_hot]]]
        pair_left[usual] = left[tally.context[usual]]
        unknown = model.unknown
        alone = np.where(counts > 0, (1 - unknown) * counts / max(model.tokens, 1), unknown)
        base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        probability = seen[tally.pair] + pair_left[tally.pair] * alone[tally.word]
        starts = np.r_[0, np.cumsum(tally.sizes)[:-1]]
        columns = [
            table.column("doc_id").combine_chunks(),
            table.column("tag").combine_chunks(),
            tally.sizes,
            np.add.reduceat((counts > 0)[tally.word].astype(np.int64), starts),
            np.add.reduceat(base[tally.word], starts),
            np.add.reduceat(np.log10(np.minimum(probability, 1.0)), starts),
        ]
        return pa.Table.from_batches([batch(_SCORES, *columns)])

    return run


def language_model_scores(docs: DataFrame, block_bytes: int = LM_BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Tokens are words with A-Z in lower case and one end per text; a null text is
    empty and has its end only.  Documents of fold 1 teach nothing.  Without training
    documents every token is unknown, with probability 1.  Repeated rows each count
    and each get their scores; null doc_ids keep their rows.
    """
    model = totals(docs)
    train = (crc_slot(FOLDS) != HELD_FOLD).cast("int")
    packed, count = blocks(docs, train, block_bytes)
    scored = ask_and_answer(
        packed,
        _ask(count, model),
        _answer(model),
        _give(count, model),
        "doc_id long, tag int, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        "doc_id",
        (F.col("tag") == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
