"""Stored queries with thresholds and phrases, tables of patterns: against plain loops."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from cinerank.operators import stored_queries
from cinerank.operators.stored_queries import match_patterns, percolate_stored
from tests.conftest import rows


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = "the the the a of red gear bolt hot cold Été naïve 42 plate zebra".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(150)] + [(200, None)]
    queries = [
        (1, "red gear", None, False), (2, "the red bolt hot", 2, False), (3, "the red bolt hot", 3, None),
        (4, "the the", None, True), (5, "gear the bolt", None, True), (6, "zebra zebra the", 1, False),
        (7, "unknown red", 1, False), (8, "unknown red", None, False), (9, "", 1, False), (10, None, None, True),
        (11, "ÉTÉ, naïve!", 0, False), (12, "red gear bolt", 99, False), (13, "the", None, True),
    ]
    return docs, queries


def plainly(docs, queries):
    found = []
    for query_id, text, least, phrase in queries:
        wanted = tokens(text)
        terms = set(wanted)
        need = len(terms) if phrase or least is None else max(1, min(least, len(terms)))
        for doc_id, body in docs:
            held = tokens(body)
            enough = len(terms & set(held)) >= need
            if phrase:
                enough = any(held[i : i + len(wanted)] == wanted for i in range(len(held)))
            if wanted and enough:
                found.append((query_id, doc_id, len(terms & set(held))))
    return sorted(found, key=repr)


def test_thresholds_and_phrases(spark, corpus):
    docs, queries = corpus
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    stored = spark.createDataFrame(queries, "id int, query string, least int, phrase boolean")
    found = percolate_stored(frame, "doc_id", "text", stored, "id", "query", "least", "phrase")
    assert rows(found) == plainly(docs, queries)
    every = [(i, q, None, False) for i, q, _, _ in queries]
    assert rows(percolate_stored(frame, "doc_id", "text", stored, "id", "query")) == plainly(docs, every)


def test_only_stored_terms_are_kept_of_documents(spark, corpus, monkeypatch):
    docs, _ = corpus
    kept = {}
    plain = stored_queries.materialise

    def seen(df, label):
        stored = plain(df, label)
        kept[label] = stored
        return stored

    monkeypatch.setattr(stored_queries, "materialise", seen)
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    stored = spark.createDataFrame([(1, "zebra plate")], "id int, query string")
    percolate_stored(frame, "doc_id", "text", stored, "id", "query").collect()
    assert {r["term"] for r in kept["held-terms"].collect()} == {"zebra", "plate"}


VALUES = ["", "a", "ab", "abc", "abcabc", "xabcx", "50%_off", "50 off", "Été", "naïve été", "line\nbreak", "zzz", "\\x"]
PATTERNS = ["*", "?", "a*", "*c", "*abc*", "a?c", "??", "???*", "50%_*", "*t?", "É*", "*\n*", "", "zz", "*z*z*z*", "no", "\\*"]


def test_patterns_of_a_table(spark):
    values = spark.createDataFrame([(v,) for v in VALUES * 2] + [(None,)], "value string")
    patterns = spark.createDataFrame(list(enumerate([*PATTERNS, None])), "id int, pattern string")
    found = match_patterns(values, "value", patterns, "id", "pattern")

    def matches(pattern, value):
        whole = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
        return re.fullmatch(whole, value, re.S) is not None

    expected = [(i, v) for i, p in enumerate(PATTERNS) for v in VALUES if matches(p, v)]
    assert rows(found) == sorted(expected, key=repr)
    assert fnmatch.fnmatchcase("xabcx", "*abc*")


def test_values_meet_patterns_by_rare_pieces(spark):
    values = spark.range(2000).select(F.concat(F.lit("Customer#"), F.lpad("id", 6, "0")).alias("value"))
    patterns = spark.createDataFrame([(1, "*#*017"), (2, "Customer#0019??"), (3, "*none*")], "id int, pattern string")
    found = rows(match_patterns(values, "value", patterns, "id", "pattern"))
    assert [v for i, v in found if i == 1] == ["Customer#000017", "Customer#001017"]
    assert len([v for i, v in found if i == 2]) == 100 and not [v for i, v in found if i == 3]


def test_nothing_stored(spark, corpus):
    frame = spark.createDataFrame(corpus[0], "doc_id int, text string")
    none = spark.createDataFrame([], "id int, query string")
    assert percolate_stored(frame, "doc_id", "text", none, "id", "query").collect() == []
    assert match_patterns(frame, "text", none, "id", "query").collect() == []


def test_equal_patterns_are_matched_once(spark, monkeypatch):
    """Ids that share a pattern multiply what was found, not what is compared."""
    patterns = spark.range(40).select("id", F.lit("*#*7?").alias("pattern"))
    values = spark.range(300).select(F.format_string("Customer#%06d", "id").alias("value"))
    sizes = []
    plain = stored_queries.materialise

    def kept(df, label):
        stored = plain(df, label)
        if label == "matches":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(stored_queries, "materialise", kept)
    found = match_patterns(values, "value", patterns, "id", "pattern")
    assert found.count() == 40 * 30 and sizes == [30]


def test_every_row_of_a_value_is_found(spark):
    frame = spark.createDataFrame([("ab",), ("ab",), ("b",), (None,)], "value string")
    patterns = spark.createDataFrame([(1, "a*"), (2, "a*"), (3, "?"), (4, None)], "id int, pattern string")
    found = match_patterns(frame, "value", patterns, "id", "pattern", every=True)
    assert rows(found) == [(1, "ab"), (1, "ab"), (2, "ab"), (2, "ab"), (3, "b")]
