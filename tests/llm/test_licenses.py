"""License spans against plain searches."""

import random
import re

import numpy as np

from cinerank.llm import licenses
from cinerank.llm.licenses import GRAM, PHRASES, Template, license_spans, rolling_grams, words_of
from cinerank.llm.queries import op12_licenses

SCHEMA = "doc_id long, text string, did string, votes string, gram string"


def words_plainly(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def places(text):
    words = words_plainly(text)
    found = []
    for phrase in PHRASES:
        wanted = phrase.text.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                found.append((i, phrase.label))
    return len(words), found


def made(rng):
    parts = [
        "Released under the MIT License.", "under the\nmit -- LICENSE", "Apache License, Version 2.0", "CC BY-NC 4.0",
        "cc by nc cc by nc", "the MIT", "license", "Version 2", "über Größe", "a_b`c", "mitten under", "x\x85y\xa0z", "...",
    ]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(i, text) for i, text in enumerate(texts)]
    return rows + [(1, texts[3]), (3, texts[3]), (None, texts[5]), (None, None), (7, ""), (8, "cc by nc " * 3000)]


def digest(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in op12_licenses(spark, str(tmp_path)).collect()]


def test_phrases_are_all_found(spark, tmp_path):
    rows = made(random.Random(3))
    expected = []
    for doc_id, text in rows:
        n, found = places(text)
        starts = [i for i, _ in found]
        labels = ",".join(sorted({label for _, label in found}))
        expected.append(
            (doc_id, n, len(found), min(starts, default=None), max(starts, default=None), labels)
        )
    got = digest(spark, tmp_path, rows)
    assert sorted((r[:6] for r in got), key=repr) == sorted(expected, key=repr)
    for row in got:
        assert set(row[5].split(",")) - {""} <= set(row[6].split(","))
        assert 0.0 <= row[7] <= 1.0 and (row[7] == 1.0 if row[2] else row[7] < 1.0 or row[6])


def test_changed_copies_are_found_and_prose_is_not(spark):
    notice = next(t for t in licenses.NOTICES if t.label == "bsd")
    words = notice.text.split()
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(300)]
    around = " ".join(rng.choices(filler, k=200))
    changed = words[:6] + ["very", "much"] + words[6:12] + words[13:]
    texts = [
        f"{around} {' '.join(words)} {around}", f"{around} {' '.join(changed)}",
        f"{notice.text} {around} {notice.text}", " ".join(words[:6]), around,
        " ".join(reversed(words)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in license_spans(docs).collect()}
    assert [(s["label"], s["start"], s["coverage"]) for s in found[0]] == [("bsd", 200, 1.0)]
    assert [s["label"] for s in found[1]] == ["bsd"] and 0.7 < found[1][0]["coverage"] < 1.0
    assert [s["label"] for s in found[2]] == ["bsd", "bsd"]
    assert not found[3] and not found[4] and not found[5]


def test_long_texts_by_stretches(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "cde", "é" * 9, "f"]) for _ in range(5000)).encode()
    whole = np.concatenate([g for _, g in rolling_grams(text)])
    assert len(whole) == 5000 - GRAM + 1
    monkeypatch.setattr(licenses, "STRETCH", 100)
    monkeypatch.setattr(licenses, "CHUNK", 7)
    parts = list(rolling_grams(text))
    assert [at for at, _ in parts] == np.cumsum([0, *(len(g) for _, g in parts)])[:-1].tolist()
    assert (np.concatenate([g for _, g in parts]) == whole).all()
    assert b"".join(licenses.stretches(text)) == text
    assert sum(len(words_of(s)) for s in licenses.stretches(text)) == 5000


def test_spans_across_stretches(spark, monkeypatch):
    check = licenses._verified([Template("a", "one two three four", True)], 0.7)
    import pyarrow as pa

    text = "x " * 500 + "one two three four " + "y " * 500
    monkeypatch.setattr(licenses, "STRETCH", 997)
    spans = [{"template": 0, "low": 500, "until": 504}, {"template": 0, "low": 498, "until": 502}]
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "votes": [spans]})
    out = next(check([rows])).to_pylist()[0]
    assert out["n_words"] == 1004 and [s["start"] for s in out["spans"]] == [500]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_spans(docs).collect() == []
