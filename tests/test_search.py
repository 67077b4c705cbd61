import math
import re

import pytest
from pyspark.sql import functions as F

from cinerank.operators import extras
from cinerank.operators import search as search_module
from cinerank.operators.search import (
    _requirements,
    build_index,
    read_index,
    search,
    search_texts,
    write_index,
)
from cinerank.session import scratch_path
from tests.conftest import rows

WORDS = "red blue hot cold gear bolt plate Été naïve 42 of the".split()


def make_docs(n):
    """Titles repeat heavily, 'the' is in most of them, genres are few."""
    docs = []
    for i in range(n):
        words = [WORDS[(i * 7 + j * j * 3) % len(WORDS)] for j in range(1 + i % 4)]
        title = " ".join(words) + (" the" if i % 3 else " The the!")
        docs.append((i, title, ["Drama,War", "Comedy", "", None][i % 4]))
    return docs


def tokens(text):
    return [t for t in re.split(r"[^\w]+", (text or "").lower()) if t]


def brute_force(docs, query, k, fields=(1, 2)):
    best = {}
    for f in fields:
        terms = {d[0]: tokens(d[f]) for d in docs}
        mean = sum(map(len, terms.values())) / len(docs)
        for term in tokens(query):
            df = sum(term in t for t in terms.values())
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for doc, t in terms.items():
                tf = t.count(term)
                if tf:
                    part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
                    best.setdefault((doc, f), 0.0)
                    best[doc, f] += part
    scores = {}
    for (doc, _), s in best.items():
        scores[doc] = max(scores.get(doc, 0), round(s, 6))
    ranked = sorted(scores, key=lambda doc: (-scores[doc], doc))[:k]
    return [(doc, rank) for rank, doc in enumerate(ranked, 1)]


QUERIES = [
    "the",
    "red gear",
    "The THE the hot",
    "drama bolt of the",
    "été, naïve?",
    "42",
    "!!! ...",
    "",
    "nothing known",
    "comedy comedy war",
    "bolt unknownword cold plate blue red of",
]


@pytest.fixture(scope="module")
def catalogue(spark):
    docs = make_docs(130)
    frame = spark.createDataFrame(docs, "movie_id int, title string, genres string")
    return docs, frame


@pytest.mark.parametrize("k", [1, 3, 10, 200])
def test_search_equals_brute_force(spark, catalogue, k):
    docs, frame = catalogue
    index = build_index(frame, "movie_id", ["title", "genres"])
    requests = spark.createDataFrame(list(enumerate(QUERIES)), "request_id int, query string")
    found = {}
    for request, doc, rank in rows(search(requests, "request_id", "query", index, k), "request_id", "doc_id", "rank"):
        found.setdefault(request, []).append((doc, rank))
    for i, text in enumerate(QUERIES):
        ours = sorted(found.get(i, []), key=lambda hit: hit[1])
        assert ours == brute_force(docs, text, k), text


@pytest.mark.parametrize("k", [1, 4, 10])
@pytest.mark.parametrize("favour", [0.0, 1e12])
def test_both_ways_of_scoring_are_exact(spark, catalogue, k, favour):
    docs, frame = catalogue
    index = build_index(frame, "movie_id", ["title", "genres"])
    requests = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    found = {}
    hits = search_texts(requests, "query", index, k, favour)
    for text, doc, rank in rows(hits, "query", "doc_id", "rank"):
        found.setdefault(text, []).append((doc, rank))
    for text in QUERIES:
        ours = sorted(found.get(text, []), key=lambda hit: hit[1])
        assert ours == brute_force(docs, text, k), text


def test_frequent_terms_propose_next_to_nothing(spark):
    """'the' is in every title; only the rare term's documents and a page of others are met."""
    films = spark.range(3000).select(
        F.col("id").cast("int").alias("movie_id"),
        F.concat(
            F.lit("the film number "),
            "id",
            F.when(F.col("id") % 1000 == 7, " zebra").otherwise(""),
            F.when(F.col("id") % 3 == 0, " long long title").otherwise(""),
        ).alias("title"),
    )
    index = build_index(films, "movie_id", ["title"])
    terms = spark.createDataFrame(
        [(b"q", "the", 1), (b"q", "zebra", 1)], "query_id binary, term string, qtf long"
    )
    needs = _requirements(terms, index.postings, index.terms, 2, 1.0)
    assert {row["direct"] for row in needs.collect()} == {False}
    met = index.postings.join(needs, ["field", "term"]).filter("weight >= need")
    assert met.count() <= 10


def test_popular_requests_and_null(spark, catalogue):
    """Every request gets its own rows; a missing text matches nothing."""
    docs, frame = catalogue
    index = build_index(frame, "movie_id", ["title"])
    requests = spark.createDataFrame(
        [(i, "red gear") for i in range(50)] + [(99, None)], "request_id int, query string"
    )
    found = rows(search(requests, "request_id", "query", index, 2), "request_id", "doc_id")
    expected = [doc for doc, _ in brute_force(docs, "red gear", 2, fields=(1,))]
    assert sorted(found) == sorted((i, doc) for i in range(50) for doc in expected)


def test_restricted_and_stored_indexes_give_the_same_hits(spark, catalogue):
    _, frame = catalogue
    requests = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    full = build_index(frame, "movie_id", ["title", "genres"])
    wanted = spark.createDataFrame([(t,) for q in QUERIES for t in tokens(q)], "term string")
    path = scratch_path(spark, "index")
    write_index(full, path)
    expected = rows(search_texts(requests, "query", full, 5))
    assert rows(search_texts(requests, "query", read_index(spark, path), 5)) == expected
    part = build_index(frame, "movie_id", ["title", "genres"], only=wanted)
    assert rows(search_texts(requests, "query", part, 5)) == expected


def test_equal_texts_share_postings(spark):
    """A title held by many films costs one entry, not one per film."""
    films = spark.range(5000).select(
        F.col("id").cast("int").alias("movie_id"), F.lit("the same title").alias("title")
    )
    index = build_index(films, "movie_id", ["title"])
    assert index.postings.count() == 3
    assert {row[0] for row in rows(index.terms, "df")} == {5000}
    requests = spark.createDataFrame([("same",)], "query string")
    assert [r[0] for r in rows(search_texts(requests, "query", index, 3), "doc_id")] == [0, 1, 2]


def test_percolate_equals_brute_force(spark, catalogue):
    docs, frame = catalogue
    stored = [(1, "the"), (2, "red the"), (3, "gear missing"), (4, "Bolt, bolt"), (5, "?"), (6, "cold of")]
    queries = spark.createDataFrame(stored, "query_id int, query string")
    found = rows(extras.percolate(frame, "movie_id", "title", queries, "query_id", "query"))
    expected = sorted(
        (
            (q, d[0])
            for q, text in stored
            for d in docs
            if tokens(text) and set(tokens(text)) <= set(tokens(d[1]))
        ),
        key=repr,
    )
    assert found == expected


@pytest.mark.parametrize(
    "pattern, expected",
    [("a*", ["a%b", "a_b", "abb"]), ("a?b", ["a%b", "a_b", "abb"]), ("a%b", ["a%b"]), ("a_b", ["a_b"]), ("*\\*", ["c\\d"])],
)
def test_wildcards(spark, pattern, expected):
    df = spark.createDataFrame([("a%b",), ("a_b",), ("abb",), ("c\\d",)], "t string")
    assert [r[0] for r in rows(df.filter(extras.wildcard(F.col("t"), pattern)))] == expected


def test_terms_that_no_document_has_are_not_stored(spark, monkeypatch):
    stored, plain = [], search_module.materialise_measured

    def counted(df, label):
        made = plain(df, label)
        if label == "query-terms":
            stored.append(sorted(row["term"] for row in made[0].collect()))
        return made

    monkeypatch.setattr(search_module, "materialise_measured", counted)
    docs = spark.createDataFrame([(1, "red gear"), (2, "blue bolt")], "id int, title string")
    index = build_index(docs, "id", ["title"])
    asked = spark.createDataFrame([(7, "red Customer#1"), (8, "Customer#2")], "id int, title string")
    assert rows(search(asked, "id", "title", index), "id", "doc_id", "rank") == [(7, 1, 1)]
    assert stored == [["red"]]


def test_documents_are_made_once_for_an_index(spark):
    """A small input is dealt out to all cores once, not for each table of the index."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(make_docs(40), "id int, title string, genres string").coalesce(1)
    index = build_index(docs.mapInArrow(count, docs.schema), "id", ["title"])
    assert index.members.count() == 40 and made.value == 40
