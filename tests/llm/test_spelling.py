"""Spelling variants against every pair of words compared."""

import random
import re
import zlib
from collections import Counter

import pytest

from cinerank.llm import spelling
from cinerank.llm.spelling import Reduced, spelling_variants
from tests.conftest import rows

SCHEMA = "doc_id long, text string, word string, n string, key string, wid string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plainly(documents):
    counts = Counter()
    for doc_id, text in documents:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= 5 * words[word] else None
    found = []
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        found.append((word, form[word], root, n, len(near[word]), words.get(form[word])))
    return sorted(found, key=repr)


def varied(rng):
    """Documents whose words have variants, variants of variants, ties and umlauts."""
    stems = ["Straße", "window", "letter", "lettre", "garden", "señores", "Ünikum", "aaaaaa", "bababa"]
    documents = []
    for i in range(300):
        text = []
        for _ in range(60):
            word = rng.choice(stems)
            if rng.random() < 0.25:
                place = rng.randrange(len(word))
                word = rng.choice([
                    word[:place] + word[place + 1 :], word[:place] + rng.choice("abéx") + word[place:],
                    word[:place] + rng.choice("abéx") + word[place + 1 :],
                ])
            text.append(word)
        documents.append((i, rng.choice([" ", ", ", "\n", "1"]).join(text)))
    chain = "cabinet " * 180 + "cabinat " * 36 + "cobinat " * 7
    return documents + [(400, chain), (None, "window gardan " * 9), (None, None), (5, ""), (5, "×÷×÷×÷ " * 7), (6, "?!")]


def test_equals_all_pairs(spark):
    documents = varied(random.Random(4))
    docs = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in documents], SCHEMA)
    expected = plainly(documents)
    assert any(root not in (word, form) for word, form, root, *_ in expected)
    assert rows(spelling_variants(docs)) == expected
    assert rows(spelling_variants(docs, symbols=2)) == expected


def test_counts_are_sent_in_parts(spark, monkeypatch):
    documents = varied(random.Random(7))[:40]
    documents.append((99, " ".join(text for _, text in documents)))
    runs = re.compile("[a-zÀ-ÿ]{6,}")
    monkeypatch.setattr(spelling, "RUNS", 100)
    parts = list(spelling._runs(documents[-1][1], runs))
    assert len(parts) > 10
    assert sum(parts, Counter()) == Counter(runs.findall(documents[-1][1]))


def test_very_long_words(spark):
    long = "ab" * 4000
    documents = [(i, " ".join([long] * 2 + [long + "c"] * (i == 0) * 5)) for i in range(20)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = {r["word"]: r for r in spelling_variants(docs).collect()}
    assert found[long + "c"]["root"] == long and found[long]["n_near"] == 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(docs).collect() == []


@pytest.mark.parametrize("symbols", [2, 3, 5])
def test_neighbours_are_generated_once_from_one_side(symbols):
    words = ["abcdefg", "aabbaa", "xyxyxyxyxyx", "zé"]
    reduced = Reduced(words, symbols)
    table = spelling.symbol_table(symbols)
    keys = {i: [] for i in range(len(words))}
    for number, key in reduced.neighbours():
        for i, k in zip(number.tolist(), key.tolist()):
            keys[i].append(k)
    letter = {int(table[ord(c)]): c for c in "abcdefghijklmnopqrstuvwxyz"}
    for i, word in enumerate(words):
        own = [int(table[ord(c)]) for c in word]
        around = {tuple(own)}
        for place, symbol in enumerate(own):
            around.add((*own[:place], *own[place + 1 :]))
            for larger in range(symbol + 1, symbols + 1):
                around.add((*own[:place], larger, *own[place + 1 :]))
        spelled = ["".join(letter[s] for s in symbols_) for symbols_ in around]
        assert sorted(keys[i]) == sorted(int(k) for w in spelled for k in Reduced([w], symbols).own())
        assert len(set(keys[i])) == len(keys[i])
