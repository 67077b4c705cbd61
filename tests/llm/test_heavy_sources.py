"""Sources with a few very long documents, beside one that is far larger than the others."""

from collections import defaultdict

import numpy as np

from cinerank.llm.mixing import draw_large, mix_sources


def test_heavy_tails_beside_a_hot_source(spark):
    rng = np.random.default_rng(8)
    rows = []

    def add(source, sizes):
        first = len(rows)
        rows.extend((first + n, "w " * int(s), source) for n, s in enumerate(sizes))

    for n, longest in enumerate((20_000, 60_000, 20_000, 60_000)):
        add(f"a{n}", [*np.maximum(rng.lognormal(4.5, 1, 1000), 1), longest])
    for n in range(4):
        add(f"b{n}", [*np.maximum(rng.lognormal(4.5, 1, 300), 1), 20_000])
    add("hot", [*np.maximum(rng.lognormal(3, 0.5, 9000), 1), 30_000, 9_000])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mix_sources(docs).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"]
    far = {s: taken[s] / target[s] - 1 for s in target}
    assert all(abs(x) <= 0.005 for x in far.values()), far


def test_large_documents_are_drawn_fairly():
    """Where the rest can make up for either draw, each document has its share of them."""
    sizes = np.array([300.0, 200.0, 100.0])
    draws = [draw_large(sizes, 0.4, 4000.0, np.random.default_rng(n)) for n in range(3000)]
    assert np.abs(np.mean(draws, axis=0) - 0.4).max() < 0.04
    # Nothing but one document: the nearer side.
    assert draw_large(np.array([9.0]), 0.7, 0.0, np.random.default_rng(1)).tolist() == [True]
    assert draw_large(np.array([9.0]), 0.3, 0.0, np.random.default_rng(1)).tolist() == [False]
