"""Cross-tokenizer alignment against the libraries on whole texts and loops over offsets."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from cinerank.llm import alignment
from cinerank.llm.alignment import (
    Encoder, Paths, Tokens, aligned_tokens, compose, fragment, safe_places, text_pieces, text_ranges,
)
from cinerank.llm.queries import tokenizer_path
from tests.conftest import rows

PATHS = Paths(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  blanks   three", "tab\tand\nline \n x\r\n y",
    "no\xa0break 　wide", "\x1c \x85 sep", "literal ▁ mark", "<|endoftext|> <s> </s> <unk> <0x41>",
    "Größe señor naïve ﬁ Å", "\U0001f600 \U0001f468‍\U0001f469 emoji", "日本語のテキスト と 漢字", "it's they'll I'd",
    "1234567 89,000.00 --- ...!!! ((x))", "\x00 nul", "é combining", "a" * 500, "x​y",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATHS)


def one(encoder, text):
    return encoder.encode([text_pieces(text)])[0]


def on_whole_texts(encoder, text):
    a = encoder.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = encoder.model.encode(text)
    pieces_a, pieces_b = ([t[i] for i in ids] for t, ids in zip(encoder.tables, (a, b)))
    whole = (" " + text).encode()
    return (a, b, pieces_a, pieces_b) if b"".join(pieces_a) == b"".join(pieces_b) == whole else None


def plainly(encoder, documents):
    held, pairs, best = [], Counter(), defaultdict(int)
    for doc_id, text in documents:
        found = on_whole_texts(encoder, text) if text else None
        if not found:
            held.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b, pieces_a, pieces_b = found
        ends_a, ends_b = np.cumsum([*map(len, pieces_a)]), np.cumsum([*map(len, pieces_b)])
        links = []
        for i, x in enumerate(a):
            low, high = ends_a[i] - len(pieces_a[i]), ends_a[i]
            for j in range(int(np.searchsorted(ends_b, low, "right")), len(b)):
                if ends_b[j] - len(pieces_b[j]) >= high:
                    break
                links.append((x, b[j]))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            until_a, until_b = (int(np.searchsorted(e, cut)) + 1 for e in (ends_a, ends_b))
            groups.append(",".join(map(str, a[i:until_a])) + "|" + ",".join(map(str, b[j:until_b])))
            i, j = until_a, until_b
        pairs.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        held.append((doc_id, len(a), len(b), len(groups), links, digest))
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (d, n_a, n_b, n_groups, len(links), sum(pairs[p] == best[p[1]] for p in links),
             sum(pairs[p] for p in links), digest)
            for d, n_a, n_b, n_groups, links, digest in held
        ),
        key=repr,
    )


def mixed_text(rng, n):
    parts = ["the", "Zürich", "it's", "x=1;", "\n", "\t", "", "", "日本", "(foo)", "12345", "naïve", "…", "\U0001f600"]
    return " ".join(rng.choice(parts) + rng.choice(["", "s", "ing", ".", ","]) for _ in range(n))


def documents_for(rng):
    texts = [*ODD, *(mixed_text(rng, rng.randrange(80)) for _ in range(60))]
    documents = list(enumerate(texts)) + [(3, texts[30]), (30, texts[30]), (None, texts[31]), (None, None)]
    long = mixed_text(rng, 3000)
    return documents + [
        (900, long), (900, long), (901, long), (None, long), (902, long + " ▁"), (903, "z" * 3000 + " " + long),
        (904, "q" * 5000), (905, " " * 3000), (906, "日本語" * 900), (907, long.replace(" ", "\xa0")),
    ]


def test_equals_plain_alignment(spark, encoder):
    documents = documents_for(random.Random(2))
    frame = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in documents], "doc_id long, text string, name string, block string, pair string, parts string")
    expected = plainly(encoder, documents)
    assert rows(aligned_tokens(frame, PATHS).select(COLUMNS)) == expected
    small = aligned_tokens(frame, PATHS, range_bytes=700, block_bytes=5000, fan=2).select(COLUMNS)
    assert rows(small) == expected


def test_ranges_that_cut_words(spark, encoder):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    documents = [(1, text), (2, text[5:])]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    expected = plainly(encoder, documents)
    for size in (31, 97):
        assert rows(aligned_tokens(frame, PATHS, range_bytes=size, fan=3).select(COLUMNS)) == expected


def test_pieces_tokenise_as_whole_texts(encoder):
    rng = random.Random(8)
    for text in [*(t for t in ODD if t), *(mixed_text(rng, 40) for _ in range(300))]:
        found, whole = one(encoder, text.encode()), on_whole_texts(encoder, text)
        assert (found is None) == (whole is None), text
        if found is not None:
            assert [found.a.tolist(), found.b.tolist()] == [list(whole[0]), list(whole[1])], text


def random_fragments(rng, encoder):
    text = mixed_text(rng, 300).strip().encode()
    sizes = encoder.sizes
    out = []
    for idx, (low, begin, end, body) in enumerate(text_ranges(text, rng.choice([5, 11, 23, 60]))):
        tokens = one(encoder, body[1:])
        f = fragment(tokens, sizes, low, begin, end)
        raw = [ids.tobytes() for part in (f.prefix, f.suffix) for ids in part]
        row = dict(zip(("pa", "pb", "sa", "sb"), raw), at=idx, first=idx if f.cut else -1, cut=f.cut, ok=True)
        out.append((row, [idx, f.closed.a.tolist(), f.closed.b.tolist()]))
    return text, out


def test_composition_is_associative_and_whole(encoder):
    rng = random.Random(11)
    for _ in range(30):
        text, parts = random_fragments(rng, encoder)
        fragments = [row for row, _ in parts]
        total, closed = compose(fragments)
        cut = rng.randrange(1, len(fragments)) if len(fragments) > 1 else 1
        left, first = compose(fragments[:cut])
        if cut < len(fragments):
            right, second = compose(fragments[cut:])
            again, third = compose([left, right])
            assert {**again, "at": 0} == {**total, "at": 0}
            assert sorted(c["at"] for c in first + second + third) == sorted(c["at"] for c in closed)
        pieces = [(2 * idx + 1, a, b) for _, (idx, a, b) in parts]
        pieces += [(2 * c["at"], *(np.frombuffer(c[s], np.uint32).tolist() for s in "ab")) for c in closed]
        whole = one(encoder, text)
        for stream in (1, 2):
            assert [i for p in sorted(pieces) for i in p[stream]] == whole[stream - 1].tolist()
        assert total["cut"] and not any(total[c] for c in ("pa", "pb", "sa", "sb"))


def test_places_to_cut_are_gaps():
    for text in ODD:
        raw = b" " + (text or "").encode()
        places = safe_places(raw).tolist()
        assert [raw[a:b] for a, b in zip(places, [*places[1:], len(raw)])] == [
            b" " + p for p in text_pieces(raw[1:])
        ] or not text


def test_memory_of_pieces_is_bounded(monkeypatch, encoder):
    fresh = Encoder(PATHS)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "PIECE_BYTES", 8)
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(str(rng.randrange(10**12)) for _ in range(20)) + " ▁"[: rng.randrange(3)]
        got, expected = one(fresh, text.encode()), one(encoder, text.encode())
        assert (got is None) == (expected is None)
        assert got is None or all((x == y).all() for x, y in zip(got, expected))
        assert len(fresh.known) <= 50 and all(len(p) <= 8 for p in fresh.known)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert aligned_tokens(frame, PATHS).collect() == []
