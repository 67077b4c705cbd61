"""The model of words that are in most documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinerank.llm import ngrams
from cinerank.llm.blocks import blocks
from cinerank.llm.bpe import encode
from cinerank.llm.queries import tokenizer_path
from cinerank.llm.ngrams import language_model_scores

PHRASE = "all rights reserved by the owner".split()


def documents():
    rng = random.Random(21)
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = PHRASE
        if i % 5 == 0:
            # After a word of the phrase, what seldom or never follows it.
            words += [PHRASE[i % len(PHRASE)], f"w{rng.randrange(3000)}"]
        rows.append((i, " ".join(words)))
    return rows


def scores(rows):
    """By counting, with the same steps of weights."""
    tokens = {i: [*t.split(), "\n"] for i, t in rows}
    train = [tokens[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    single = Counter(w for t in train for w in t)
    after = defaultdict(Counter)
    for t in train:
        for a, b in zip(["\t", *t], t):
            after[a][b] += 1
    total, once = sum(single.values()), sum(n == 1 for n in single.values())
    unknown = (once + 1) / (total + 1 + (once == total))

    def step(weight):
        return ngrams.WEIGHT[ngrams.quantise(np.array([weight]))][0]

    found = {}
    for i, t in tokens.items():
        found[i] = 0.0
        for a, b in zip(["\t", *t], t):
            n = sum(after[a].values())
            left = step(min(0.75 * len(after[a]) / n, 1.0) if n else 1.0)
            seen = step((after[a][b] - 0.75) / n) if after[a][b] else 0.0
            alone = (1 - unknown) * single[b] / total if single[b] else unknown
            found[i] += math.log10(min(seen + left * alone, 1.0))
    return found


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_scores_do_not_depend_on_blocks(spark, block_bytes):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["score"] for r in language_model_scores(docs, block_bytes).collect()}
    want = scores(rows)
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-9) for i in want)


def test_equal_rows_use_many_blocks(spark, tmp_path):
    row = [(1, "the same words again and again " * 20)]
    spark.createDataFrame(row * 4000, "doc_id long, text string").write.parquet(f"{tmp_path}/equal")
    docs = spark.read.parquet(f"{tmp_path}/equal")
    packed, count = blocks(docs, block_bytes=1 << 16)
    sizes = [r["count"] for r in packed.groupBy("block").count().collect()]
    assert count > 30 and len(sizes) > 0.9 * count and max(sizes) < 4 * 4000 / count
    encoded = encode(docs, tokenizer_path(), block_bytes=1 << 16)
    assert encoded.count() == 4000 and encoded.select("ids").distinct().count() == 1
