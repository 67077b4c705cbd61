"""Scores of the trained models beside the same models written out plainly."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

from cinerank.llm.language import PROFILE, languages
from cinerank.llm.quality import DIAGONAL, POOLED, quality_scores, statistics

ALPHABETS = {"aa": "abcdefghij", "bb": "fghijklmnopqé", "cc": "abcxyzñяж"}


def texts_in_languages():
    """Texts of three languages that share letters; some without a language, a text or letters."""
    rng = random.Random(17)
    rows = []
    for i in range(160):
        lang = rng.choice(list(ALPHABETS))
        letters = ALPHABETS[lang]
        words = ["".join(rng.choices(letters, range(len(letters), 0, -1), k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words).title() if i % 3 else ", ".join(words), None if i % 11 == 0 else lang))
    return [*rows, (160, None, "aa"), (161, "", "bb"), (162, "12 + 3!", "cc"), (None, "abc xyz", "cc")]


def slot(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def plain_grams(text):
    """One to three characters of words between blanks, the blank alone left out."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = kept.split()
    if not any(unicodedata.category(c)[0] == "L" for c in kept):
        return Counter()
    line = " " + " ".join(words) + " "
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " ")


def in_order(counts):
    """Most frequent first; ties: shorter first, then by code points."""
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:PROFILE]


def test_languages_equal_plain_distances(spark):
    rows = texts_in_languages()
    learned = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if slot(doc_id, 4) != 2 and lang is not None:
            learned[lang] += plain_grams(text)
    places = {lang: {g: i for i, g in enumerate(in_order(c))} for lang, c in learned.items() if c}
    expected = []
    for doc_id, text, _ in rows:
        top = in_order(plain_grams(text))
        if not top:
            expected.append((doc_id, "und", 0.0))
            continue
        close = {}
        for lang, place in places.items():
            apart = sum(abs(place[g] - i) if g in place else PROFILE for i, g in enumerate(top))
            close[lang] = 1 - apart / (PROFILE * len(top))
        best = max(sorted(close), key=lambda lang: close[lang])
        expected.append((doc_id, best, close[best] / sum(close.values())))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in languages(docs).collect()]
    expected, found = sorted(expected, key=repr), sorted(found, key=repr)
    assert [e[:2] for e in expected] == [f[:2] for f in found]
    assert all(math.isclose(e[2], f[2], abs_tol=1e-9) for e, f in zip(expected, found, strict=True))


def test_quality_equals_a_plain_discriminant(spark):
    rng = random.Random(23)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        words = [rng.choice(["the", "river", "9", "Town,", "##", "of"] if good else ["BUY", "!!", "buy", "$$", "now9"]) for _ in range(rng.randint(0, 50))]
        rows.append((i, " ".join(words)))
        if i % 7:
            labels += [(i, int(good))] * (1 + (i % 13 == 0))
    rows += [(900, None), (None, "a row without an id")]
    vectors = {i: np.array(statistics((text or "").encode())) for i, text in rows}
    taught = [(vectors[i], k) for i, k in labels if slot(i, 5)]
    x, y = np.array([v for v, _ in taught]), np.array([k for _, k in taught])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))
    spread = np.diag(np.maximum(np.diag(pooled), 1e-3))
    width = len(spread)

    def log_density(v, k):
        pool = max(POOLED, width / (width + (y == k).sum()))
        shrunk = (1 - pool) * ((1 - DIAGONAL) * own[k] + DIAGONAL * spread) + pool * pooled
        shrunk = shrunk + 1e-6 * spread + 1e-9 * np.eye(width)
        apart = v - x[y == k].mean(axis=0)
        return -0.5 * (apart @ np.linalg.solve(shrunk, apart) + np.linalg.slogdet(shrunk)[1])

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    for row in quality_scores(docs, frame).collect():
        v = vectors[row["doc_id"]]
        odds = log_density(v, 1) - log_density(v, 0) + math.log(y.mean() / (1 - y.mean()))
        assert math.isclose(row["score"], 1 / (1 + math.exp(-np.clip(odds, -500, 500))), rel_tol=1e-5, abs_tol=1e-9)
        assert row["held_out"] == (slot(row["doc_id"], 5) == 0)
