"""Spelling variants: words that differ by one letter, and the form each stands for.

Letters are hashed to a few symbols.  Two words one edit apart have reduced words that
are equal or one edit apart, so the full one-edit neighbourhood of a reduced word, over
the few symbols, meets every reduced word that can matter.  Being neighbours is mutual:
of the two words of a meeting one generates it, the longer one by a deletion, or the one
with the smaller symbol by a replacement.  Neighbours are generated as 64-bit keys,
joined to the keys of the reduced vocabulary, and the original strings of each meeting
are compared.

Cost: one pass over the texts, in which each task counts before the shuffle; then about
``length * symbols / 2`` rows of 16 bytes per word of the vocabulary, which grows far
slower than the text.  No step pairs the members of a group: a word meets the words
whose reduced form is in its own neighbourhood.  A form has at most as many variants as
one edit can make, a number that does not depend on the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cinerank.llm.anchors import mixed, powers
from cinerank.llm.common import batch, parts_for, texts_of
from cinerank.session import materialise

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SYMBOLS = 16
# A run is shortened where this divides its checksum.
DELETES = 199

# Distinct words that a task holds before it sends their counts.
HELD = 1 << 19
# Runs of one text that are counted together.
RUNS = 1 << 18
# Letters of the words whose neighbourhoods are made together.
LETTERS = 1 << 15
# Neighbours that one task makes.
NEIGHBOURS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("wid", pa.int64())])


def _runs(text: str, pattern: re.Pattern) -> Iterator[Counter]:
    if len(text) <= RUNS:
        yield Counter(pattern.findall(text))
        return
    found = pattern.finditer(text)
    while part := Counter(match.group() for match in islice(found, RUNS)):
        yield part


def _count_words(least: int):
    # Shorter runs cannot give a word; a greedy match of the class is a maximal run.
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for rows in batches:
            for doc_id, text in zip(
                rows.column("doc_id").to_pylist(), texts_of(rows.column("text")), strict=True
            ):
                begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower changes A-Z only.
                for counts in _runs(text.lower().decode("utf-8", "replace"), pattern):
                    for word, n in counts.items():
                        check = zlib.crc32(word.encode(), begin)
                        if check % DELETES == 0:
                            place = check % len(word)
                            word = word[:place] + word[place + 1 :]
                            if len(word) < least:
                                continue
                        held[word] = held.get(word, 0) + n
                    if len(held) > HELD:
                        yield batch(_COUNTS, list(held), list(held.values()))
                        held = {}
        if held:
            yield batch(_COUNTS, list(held), list(held.values()))

    return run


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """Words of the whole texts and how often they occur: word, n."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        source.mapInArrow(_count_words(least_length), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least_count)
    )


def symbol_table(symbols: int) -> np.ndarray:
    """The symbol, from 1 to ``symbols``, of each letter of the first 256 code points."""
    return (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(33)) % np.uint64(
        symbols
    ) + np.uint64(1)


class Reduced:
    """Reduced words of a batch, side by side, with keys of themselves and their neighbours.

    The key of a reduced word is a polynomial in its symbols, so that an edit changes it
    by a sum, plus its length.
    """

    def __init__(self, words: list[str], symbols: int):
        self.symbols = symbols
        flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.symbol = symbol_table(symbols)[flat]
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.length)
        self.word = np.repeat(np.arange(len(words)), self.length)
        power = powers(_BASE, max(64, 1 << int(self.length.max()).bit_length()))
        self.weight = power[np.arange(len(flat)) - np.repeat(self.end - self.length, self.length)]
        sums = np.r_[np.uint64(0), np.cumsum(self.symbol * self.weight)]
        begin = sums[self.end - self.length]
        self.whole = sums[self.end] - begin
        self.before = sums[:-1] - begin[self.word]

    def _key(self, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed(value + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)

    def own(self) -> np.ndarray:
        return self._key(self.whole, self.length)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of the word and key of a neighbour, each of these once: the word itself,
        the words with one symbol less, and those with one symbol replaced by a larger one.

        Deleting any symbol of a run of equal ones gives the same word, so only the last is.
        """
        word, symbol, weight, before = self.word, self.symbol, self.weight, self.before
        whole, length = self.whole[word], self.length[word]
        yield np.arange(len(self.length)), self.own()
        last = np.ones(len(symbol), bool)
        last[:-1] = (symbol[1:] != symbol[:-1]) | (word[1:] != word[:-1])
        back = np.uint64(pow(_BASE | 1, -1, 1 << 64))
        rest = whole - before - symbol * weight
        yield word[last], self._key(before + rest * back, length - 1)[last]
        for c in range(2, self.symbols + 1):
            value = np.uint64(c)
            less = symbol < value
            yield word[less], self._key(whole + (value - symbol) * weight, length)[less]


def _slices(words: list[str]) -> Iterator[slice]:
    begin, letters = 0, 0
    for i, word in enumerate(words):
        letters += len(word)
        if letters >= LETTERS:
            yield slice(begin, i + 1)
            begin, letters = i + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


def _keys(symbols: int, neighbours: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = rows.column("word").to_pylist()
            wid = rows.column("wid").to_numpy()
            for part in _slices(words):
                reduced = Reduced(words[part], symbols)
                if neighbours:
                    for word, key in reduced.neighbours():
                        yield batch(_KEYS, key, wid[part][word])
                else:
                    yield batch(_KEYS, reduced.own(), wid[part])

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs of words one edit apart, in both orders: word, near, near_n.

    ``words`` has word and n, each word once, of letters up to U+00FF.  A word is named
    by 64 bits of hash between the joins; the comparison of strings settles collisions.
    Words that are reduced to the same one meet from both sides and have their rows twice.
    """
    named = words.select("word", "n", F.xxhash64("word").alias("wid"))
    letters = named.agg(F.sum(F.length("word"))).first()[0] or 0
    spread = named.repartition(parts_for(symbols * letters // 2, NEIGHBOURS), "wid")
    made = spread.mapInArrow(_keys(symbols, True), "key long, wid long")
    held = named.mapInArrow(_keys(symbols, False), "key long, wid long")
    met = made.join(held.withColumnRenamed("wid", "near_wid"), "key").select("wid", "near_wid")
    near = named.select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("wid").alias("near_wid")
    )
    either = [
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    ]
    return (
        met.filter("wid <> near_wid")
        .join(named, "wid")
        .join(near, "near_wid")
        .filter(F.levenshtein("word", "near", 1) == 1)
        .select(F.inline(F.array(*either)))
    )


def follow(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for rows of word and form.

    Each round doubles the length of chain that is known.  A form occurs at least
    ``RATIO`` times as often as its variant, so chains are short and have no circles.
    """
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        seen = Observation()
        known = materialise(
            known.join(further, "root", "left")
            .observe(seen, F.count("_next").alias("moved"))
            .select("word", F.coalesce("_next", "root").alias("root")),
            "roots",
        )
        if not seen.get.get("moved"):
            return known


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (ties: the smaller one) if that occurs at
    least ``ratio`` times as often; ``root`` is where forms lead.  Null and empty texts
    have no words, a null doc_id counts as an empty one, repeated rows count again,
    an empty table gives an empty result.
    """
    words = materialise(vocabulary(docs, least_length, least_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    # A set of near words has as many members as one edit can make, at most.
    around = near_words(words, symbols).groupBy("word").agg(
        F.size(F.collect_set("near")).alias("n_near"), best.alias("_best")
    )
    most = -F.col("_best.less")
    enough = most >= ratio * F.col("n")
    judged = materialise(
        words.join(around, "word", "left").select(
            "word",
            F.when(enough, F.col("_best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, most).cast("long").alias("form_n"),
        ),
        "spelling",
    )
    roots = follow(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
