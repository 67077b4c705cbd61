"""Rows without ids, or with one id, are documents of their own."""

import random
from collections import defaultdict

import pytest

from cinerank.llm.common import NO_ID, keyed
from cinerank.llm.near_dedup import near_duplicates
from cinerank.llm.substrings import dedup_substrings
from cinerank.llm.suffixes import dedup_suffixes


@pytest.fixture(scope="module")
def unnamed(spark):
    """Null ids and one repeated id, texts of all lengths; each third shares a passage."""
    rng = random.Random(11)

    def run_of(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passages = [run_of(60) for _ in range(5)]
    rows = []
    for n in range(3000):
        shared = passages[n % 5] if n % 3 == 0 else []
        words = run_of(rng.randint(1, 40)) + shared + run_of(rng.randint(1, 30))
        rows.append((None if n % 2 else 7, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()


def in_order(docs):
    rows = keyed(docs).collect()
    assert len({(r["did"], r["tk"]) for r in rows}) == len(rows)
    return [(r["did"], r["text"]) for r in sorted(rows, key=lambda r: (r["did"], r["tk"]))]


def brute(pieces, width):
    """What is kept of each, a window of an earlier one removed."""
    seen, kept = {}, []
    for me, piece in enumerate(pieces):
        gone = set()
        for p in range(len(piece) - width + 1):
            if seen.setdefault(piece[p : p + width], me) < me:
                gone.update(range(p, p + width))
        kept.append([x for i, x in enumerate(piece) if i not in gone])
    return kept


def by_id(docs, kept):
    found = defaultdict(list)
    for (did, _), k in zip(docs, kept, strict=True):
        found[None if did == NO_ID else did].append(k)
    return {k: sorted(v) for k, v in found.items()}


def got(frame):
    found = defaultdict(list)
    for row in frame.select("doc_id", "kept").collect():
        found[row["doc_id"]].append(bytes(row["kept"]))
    return {k: sorted(v) for k, v in found.items()}


def test_substrings_of_unnamed_rows(unnamed):
    docs = in_order(unnamed)
    kept = brute([tuple(t.encode().split()) for _, t in docs], 50)
    assert got(dedup_substrings(unnamed)) == by_id(docs, [b" ".join(k) for k in kept])


def test_suffixes_of_unnamed_rows(unnamed):
    docs = in_order(unnamed)
    kept = brute([t.encode() for _, t in docs], 100)
    assert got(dedup_suffixes(unnamed)) == by_id(docs, [bytes(k) for k in kept])


def test_unrelated_unnamed_rows_share_no_component(spark):
    """A chain of near copies with ids; unnamed rows must not tie the chains together."""
    rng = random.Random(12)
    rows, want = [], {}
    for n in range(1500):
        words = [f"v{rng.randrange(10**6)}" for _ in range(20)]
        rows.append((None, " ".join(words)))
        rows.append((n, " ".join([*words, "end"])))
        want[n] = n
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = near_duplicates(docs, 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert sorted(r["component_id"] for r in found if r["doc_id"] is None) == sorted(want)
