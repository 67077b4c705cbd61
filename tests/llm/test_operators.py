"""Each operator against a plain computation, on a table with every odd case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinerank.llm import ngrams
from cinerank.llm.anchors import Shape
from cinerank.llm.bpe import decode, encode, words
from cinerank.llm.exact_dedup import exact_duplicates
from cinerank.llm.fingerprints import fingerprints
from cinerank.llm.language import languages
from cinerank.llm.mixing import fly, mix_sources, source_targets
from cinerank.llm.near_dedup import near_duplicates
from cinerank.llm.ngrams import language_model_scores
from cinerank.llm.quality import quality_scores
from cinerank.llm.queries import tokenizer_path
from cinerank.llm.substrings import dedup_substrings
from cinerank.llm.suffixes import Suffixes, byte_tokens, dedup_suffixes, sort_suffixes

# Columns named like the operators' own ones must not disturb them.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "did string, tk string, key string, block string, size string, mark string, tag string"
)
EXTRA = ("x",) * 7


def sentence(rng, n):
    return " ".join(rng.choice(["Ab", "the", "lo", "mi", "Zürich", "qu", "na", "of"]) + str(rng.randint(0, 300)) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base, other = sentence(rng, 160), sentence(rng, 120)
    split = base.split()
    near = " ".join(split[:80] + ["CHANGED"] + split[81:])
    long = " ".join(sentence(rng, 400) for _ in range(40))
    passage = sentence(rng, 60)
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, near), (5, None), (6, ""), (7, " \n\t "),
        (8, "word"), (9, "two words"), (10, other + "\n" + passage), (11, passage + " end"),
        (12, long), (13, long[:9000] + " tail"), (14, "the " * 700), (15, "a  b c   d<|endoftext|>e"),
        (15, "another text with the same id"), (16, other), (16, other), (None, base),
        (None, "no id"), (17, "\U0001f600 " * 30), (18, "12 34 !!"), (19, None),
    ]
    sources = ["a", "b", None, "", "b"]
    return [
        (i, t, ["en", None, "xx"][n % 3], sources[n % 5], None if t is None else len(t), *EXTRA)
        for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(frame, odd_table, *columns):
    """Result rows by doc_id; ids in use twice give several."""
    found = defaultdict(list)
    for row in frame.collect():
        found[row["doc_id"]].append(tuple(row[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in found.items()}


def expected(rows):
    found = defaultdict(list)
    for key, value in rows:
        found[key].append(value)
    return {k: sorted(v, key=repr) for k, v in found.items()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return (text or "").encode().lower()


def test_exact_duplicates(odd):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[lower(t)].append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want += [(i, (keep, len(ids), i == keep, sha(text))) for i in ids]
    got = by_text(exact_duplicates(odd), odd, "keep_id", "group_size", "kept", "text_sha256")
    assert got == expected(want)


@pytest.mark.parametrize("block_bytes", [1 << 24, 5000])
def test_bpe_equals_the_library(odd, block_bytes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in odd_rows()]
    found = encode(odd, tokenizer_path(), True, block_bytes).cache()
    assert by_text(found.select("doc_id", "ids"), odd, "ids") == expected(
        [(i, (ids,)) for i, ids in want]
    )
    texts = expected([(i, (t or "",)) for i, t, *_ in odd_rows()])
    assert by_text(found, odd, "decoded") == texts
    assert by_text(decode(found.drop("decoded"), tokenizer_path()), odd, "decoded") == texts


def test_words_keep_every_character():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "!", "'s", "1", " ", "\x1c", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert "".join(words(text)) == text


def ordered(rows):
    """Distinct documents, smallest id first, as the operators order them."""
    return sorted({(-(1 << 63) if i is None else i, t or "") for i, t, *_ in rows})


def test_substrings(odd):
    width = 50
    docs = [(i, t.encode().split()) for i, t in ordered(odd_rows())]
    firsts = {}
    for i, w in docs:
        for p in range(len(w) - width + 1):
            firsts.setdefault(tuple(w[p : p + width]), i)
    want = []
    for i, w in [(r[0], (r[1] or "").encode().split()) for r in odd_rows()]:
        me = -(1 << 63) if i is None else i
        gone = set()
        for p in range(len(w) - width + 1):
            if firsts[tuple(w[p : p + width])] < me:
                gone.update(range(p, p + width))
        want.append((i, (len(w), bytearray(b" ".join(x for k, x in enumerate(w) if k not in gone)))))
    assert by_text(dedup_substrings(odd), odd, "n_words", "kept") == expected(want)


def removed_bytes(texts, width=100):
    """Kept bytes of each text, texts in order."""
    seen, kept = set(), []
    for text in texts:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            piece = data[p : p + width]
            if piece in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(piece)
        kept.append(bytes(c for c, g in zip(data, gone) if not g))
    return kept


@pytest.mark.parametrize("most", [20_000, 0])
def test_suffixes(spark, most):
    """The sort, and the way for crowded anchors, give the same result."""
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None and i != 15]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = ordered(rows)
    kept = dict(zip(texts, removed_bytes([t for _, t in texts])))
    want = [(i, (len((t or "").encode()), bytearray(kept[i, t or ""]))) for i, t in rows]
    assert by_text(dedup_suffixes(docs, most=most), docs, "n_bytes", "kept") == expected(want)


def test_short_widths_and_many_repeats(spark):
    """A small alphabet makes equal anchors, self overlaps and long runs."""
    rng = random.Random(3)
    shape = Shape(byte_tokens, 8, 3, within=True)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = [(i, (bytearray(k),)) for i, k in enumerate(removed_bytes(texts, 8))]
    for most in (20_000, 5):
        assert by_text(dedup_suffixes(docs, shape, most), docs, "kept") == expected(want)


def test_suffix_sort_is_a_sort():
    rng = random.Random(2)
    data = "".join(rng.choice("ab") for _ in range(400)).encode()
    place = np.array([rng.randrange(380) for _ in range(200)])
    group = np.sort(np.array([rng.randrange(6) for _ in range(200)]))
    order = sort_suffixes(Suffixes(data, 16), place, group)
    padded = data + bytes(16)
    keys = [(group[i], padded[place[i] : place[i] + 16], i) for i in order]
    assert keys == sorted(keys)


def components_of(rows, size):
    sets = {}
    for key in ordered(rows):
        w = lower(key[1]).split()
        n = min(size, len(w))
        sets[key] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in sets}


@pytest.mark.parametrize("size,hubs", [(2, 512), (5, 512), (2, 1)])
def test_near_duplicates(odd, size, hubs):
    """With one hub at most, lists are posted again under more coordinates."""
    sets, roots = components_of(odd_rows(), size)
    least = defaultdict(lambda: None)
    for (i, _), root in roots.items():
        if i != -(1 << 63) and (least[root] is None or i < least[root]):
            least[root] = i
    want = []
    for i, t, *_ in odd_rows():
        key = (-(1 << 63) if i is None else i, t or "")
        component = least[roots[key]] if sets[key] else i
        want.append((i, (len(sets[key]), component, i == component)))
    got = by_text(near_duplicates(odd, size, hubs), odd, "n_shingles", "component_id", "kept")
    assert got == expected(want)


def joined_by(pairs, names, families):
    """What pairs and families connect, as sets of names."""
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    firsts = {}
    for name, family in zip(names, families):
        root[find(name)] = find(firsts.setdefault(family, name))
    for a, b in pairs:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for n in names:
        groups[find(n)].add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("short,portion", [(64, 1 << 16), (2, 7), (64, 7)])
def test_matches_across_families(monkeypatch, short, portion):
    """Long and short lists, whole or cut into portions, join the same families."""
    import pyarrow as pa

    from cinerank.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "LISTED_ROWS", portion)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (3, 48)).astype(np.uint8)
    kind = rng.integers(0, 3, 30)
    briefs = base[kind]
    briefs[:, :20] = rng.integers(0, 256, (30, 20))
    key, family = np.sort(rng.integers(0, 4, 30)), rng.integers(0, 20, 30)
    table = pa.table(
        {
            "key": key, "did": np.arange(30), "tk": np.zeros(30, np.int32), "root": family,
            "brief": [b.tobytes() for b in briefs],
        }
    )
    found = [
        pair
        for part in near_dedup._across(iter(table.to_batches(max_chunksize=4)))
        for pair in zip(part.column("did").to_pylist(), part.column("to_did").to_pylist())
    ]
    want = [
        (i, j)
        for i in range(30)
        for j in range(i)
        if key[i] == key[j] and family[i] != family[j] and (briefs[i] == briefs[j]).sum() >= 24
    ]
    assert want and set(map(frozenset, found)) <= set(map(frozenset, want))
    names = range(30)
    assert joined_by(found, names, family.tolist()) == joined_by(want, names, family.tolist())


def test_near_duplicates_of_families(spark):
    """Chains and families of copies with some words changed, no common original."""
    rng = random.Random(9)
    rows = []
    for family in range(6):
        text = [f"w{family}_{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(12):
            text = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    _, roots = components_of(rows, 2)
    want = {i: roots[i, t][0] for i, t in rows}
    for hubs in (512, 2):
        found = near_duplicates(docs, 2, hubs).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_mixing(spark, odd):
    rows = mix_sources(odd).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mix_sources(odd).collect()))
    sizes = Counter()
    for _, t, _, s, *_ in odd_rows():
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    assert all(math.isclose(r["target"], target[r["source"]]) for r in rows)
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([3, 30, 90, 400]), rng.choice("abcde" + "f" * 9)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in mix_sources(docs).collect():
        sums = found[r["source"]]
        sums[0] += r["taken"]
        sums[1] += 1
        sums[2] = r["target"]
        sums[3] += r["copies"]
    for source, (taken, docs_, target, copies) in found.items():
        assert abs(taken - target) <= 0.005 * target, source
        size = sum(len(t.split()) for _, t, s in rows if s == source)
        # The number of documents is balanced too.
        assert abs(copies - docs_ * target / size) <= 6, source


def test_targets_of_nothing(spark):
    sizes = spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")
    assert {r["target"] for r in source_targets(sizes).collect()} == {0.0}


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 300).astype(float)
    before = np.full(300, 0.37)
    after = fly(before, sizes, rng)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert math.isclose(after.sum(), before.sum(), rel_tol=1e-6)
    assert math.isclose(after @ sizes, before @ sizes, rel_tol=1e-6)


@pytest.mark.parametrize("block_bytes", [1 << 24, 5000])
def test_language_model_base(odd, block_bytes):
    def tokens(text):
        return [*lower(text).split(), None]

    def slot(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5

    counts = Counter()
    for i, t, *_ in odd_rows():
        if slot(i) != 1:
            counts.update(tokens(t))
    total = sum(counts.values())
    want = []
    for i, t, *_ in odd_rows():
        base = sum(
            math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens(t)
        )
        known = sum(counts[w] > 0 for w in tokens(t))
        want.append((i, (slot(i) == 1, len(tokens(t)), known, total, f"{base:.6f}")))
    rows = language_model_scores(odd, block_bytes).collect()
    got = [
        (r["doc_id"], (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}"))
        for r in rows
    ]
    assert expected(got) == expected(want)
    assert all(r["score"] <= 0 for r in rows)


def test_language_model_learns_pairs(spark):
    """Where order matters, the model beats single words on texts it has not seen."""
    rng = random.Random(6)
    after = {w: rng.sample(range(200), 3) for w in range(200)}
    rows = []
    for i in range(300):
        w, text = rng.randrange(200), []
        for _ in range(40):
            text.append(f"w{w}")
            w = rng.choice(after[w])
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in language_model_scores(docs).collect()}
    rows = language_model_scores(docs, 5000).collect()
    # Blocks and shards change nothing.
    assert all(math.isclose(r["score"], whole[r["doc_id"]], rel_tol=1e-9) for r in rows)
    held = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert held and sum(r["score"] for r in held) / tokens > -0.9
    assert sum(r["base_score"] for r in held) / tokens < -2.0


def test_elias_fano_and_trie():
    rng = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 1), (500, 3), (500, 10**9)):
        values = np.sort(rng.integers(0, most, n))
        assert ngrams.EliasFano.of(values).values().tolist() == values.tolist()
    keys = np.unique(rng.integers(0, 50, 400) << 40 | rng.integers(0, 90, 400))
    codes = rng.integers(1, 256, len(keys)).astype(np.uint8)
    trie = ngrams.Trie(60, keys, codes)
    asked = np.r_[keys, keys + 1, [59 << 40]]
    known = dict(zip(keys.tolist(), codes.tolist()))
    assert trie.weights(asked).tolist() == [known.get(k, 0) for k in asked.tolist()]
    assert ngrams.Trie(3, keys[:0], codes[:0]).weights(asked).max() == 0


def test_trie_searches_the_range_of_its_context_only(monkeypatch):
    """Contexts with none, one and very many successors; few of all successors are read."""
    rng = np.random.default_rng(9)
    contexts = np.minimum((rng.pareto(0.6, 60_000) * 5).astype(np.int64), 19_999)
    keys = np.unique(contexts << 40 | rng.integers(0, 1 << 40, len(contexts)))
    codes = rng.integers(1, 256, len(keys)).astype(np.uint8)
    trie = ngrams.Trie(20_000, keys, codes)
    pointers = np.searchsorted(keys >> 40, np.arange(20_001))
    some = rng.integers(0, 20_001, 300)
    assert trie.pointers.at(some).tolist() == pointers[some].tolist()
    read = []
    plain = trie._successor
    monkeypatch.setattr(trie, "_successor", lambda at: read.extend(at.tolist()) or plain(at))
    asked = np.r_[keys[rng.integers(0, len(keys), 200)], rng.integers(0, 20_000, 200) << 40]
    known = dict(zip(keys.tolist(), codes.tolist()))
    assert trie.weights(asked).tolist() == [known.get(k, 0) for k in asked.tolist()]
    ranges = [range(pointers[c], pointers[c + 1]) for c in set((asked >> 40).tolist())]
    assert set(read) <= {place for held in ranges for place in held}
    assert len(read) <= 400 * (2 + math.log2(max(map(len, ranges))))


def test_languages(spark, odd):
    rng = random.Random(8)
    words_of = {"aa": ["bada", "goba", "dagu"], "ii": ["kipi", "tiki", "piti"], "zz": ["жуза", "заж"]}
    rows = [(i, " ".join(rng.choices(words_of[lang], k=20)), lang) for i in range(90) for lang in words_of]
    rows = [(n, t, lang if n % 7 else None) for n, (_, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {n: next(k for k, v in words_of.items() if t.split()[0] in v) for n, t, _ in rows}
    found = languages(docs).collect()
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1 for r in found)
    for i, t, *_ in odd_rows():
        if t is None or not any(c.isalpha() for c in t):
            assert ("und", 0.0) in by_text(languages(odd), odd, "lang_pred", "score")[i]
            break


def edited(rows):
    order = sorted(rows, key=lambda r: r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        text, half = t or "", len(t or "") // 2
        yield i, text, text[: len(text) - half] + (after or "")[:half]


def test_fingerprints(spark, odd):
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None and i not in (15, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    for i, text, changed in edited(rows):
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == sha(changed)
    prints = {i: found[i]["fingerprint"] for i in found}
    assert prints[1] == prints[2] and prints[5] == prints[6] and prints[1] != prints[3]
    # The same texts as documents have the prints that their edited twins had.
    twins = [(i, changed) for i, _, changed in edited(rows)]
    again = spark.createDataFrame(twins, "doc_id long, text string")
    for r in fingerprints(again).collect():
        assert r["fingerprint"] == found[r["doc_id"]]["edited_fingerprint"]
    assert all(0 <= r[c] <= 1 for r in found.values() for c in ("near_edited", "near_next"))
    assert found[1]["near_next"] == 1.0
    assert 0.3 < found[12]["near_edited"] < 0.8
    assert fingerprints(odd).count() == len(odd_rows())


def test_fingerprints_ignore_order_of_paragraphs(spark):
    rng = random.Random(2)
    lines = [sentence(rng, 4) for _ in range(40)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(lines[1:]))]
    found = {
        r["doc_id"]: r
        for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    }
    assert found[1]["fingerprint"] == found[2]["fingerprint"] != found[3]["fingerprint"]
    assert found[2]["near_next"] > 0.9


def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randint(30, 200)) if good else ("%$ " + "AA!! ") * rng.randint(9, 90)
        rows.append((i, text))
        labels.append((i, int(good)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int"),
        dict(labels),
    )


def test_quality(spark, odd):
    docs, labels, truth = labelled(spark)
    rows = quality_scores(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_scores(odd, labels).count() == len(odd_rows())
    none = quality_scores(odd, labels.filter("false")).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    only = quality_scores(odd, labels.filter("quality = 1")).select("score").distinct().collect()
    assert [r["score"] for r in only] == [1.0]


@pytest.mark.parametrize(
    "operator",
    [
        exact_duplicates,
        dedup_substrings,
        dedup_suffixes,
        near_duplicates,
        mix_sources,
        language_model_scores,
        languages,
        fingerprints,
        lambda docs: encode(docs, tokenizer_path(), decoded=True),
        lambda docs: quality_scores(docs, docs.selectExpr("doc_id", "1 AS quality")),
    ],
)
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


def test_marks_alone_have_no_language(spark):
    rows = [(i, "the words of a text " * 5, "en") for i in range(1, 30)] + [(50, "\u0301\u0301", None), (51, "e\u0301", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages(docs).collect()}
    assert found[50] == ("und", 0.0) and found[51][0] == "en"
