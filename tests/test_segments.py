"""A stored index after appends, replacements and removals equals one built anew."""

import pytest
from pyspark.sql import functions as F

from cinerank.operators.search import build_index, query_term_rows, search, search_texts
from cinerank.operators.segments import (
    add_documents,
    compact,
    open_index,
    remove_documents,
    term_statistics,
)
from cinerank.session import scratch_path
from cinerank.sinks import snapshots
from cinerank.sinks.snapshots import current, publish_version, published_lists
from tests.conftest import rows
from tests.test_search import QUERIES, make_docs

SCHEMA = "movie_id int, title string, genres string"
FIELDS = ["title", "genres"]


@pytest.fixture(scope="module")
def changed(spark):
    """An index after four changes, and the documents that are live then."""
    path = scratch_path(spark, "index")
    docs = make_docs(130)
    add_documents(spark.createDataFrame(docs[:70], SCHEMA), "movie_id", FIELDS, path)
    add_documents(spark.createDataFrame(docs[70:], SCHEMA), "movie_id", FIELDS, path)
    gone = [3, 10, 71, 99, 5000]
    remove_documents(spark, path, spark.createDataFrame([(i,) for i in gone], "doc_id int"))
    new = [(5, "a zebra title of gears", "War"), (10, "red gear", None), (400, "red gear", "Drama"), (401, None, "")]
    add_documents(spark.createDataFrame(new, SCHEMA), "movie_id", FIELDS, path)
    live = {d[0]: d for d in docs if d[0] not in gone} | {d[0]: d for d in new}
    return path, spark.createDataFrame(list(live.values()), SCHEMA)


def hits(spark, index, k=10):
    requests = spark.createDataFrame([(q,) for q in [*QUERIES, "zebra", "gears war"]], "query string")
    return rows(search_texts(requests, "query", index, k), "query", "doc_id", "score", "rank")


def test_equals_a_rebuild(spark, changed):
    path, live = changed
    expected = hits(spark, build_index(live, "movie_id", FIELDS))
    assert hits(spark, open_index(spark, path)) == expected
    requests = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    only = open_index(spark, path, only=query_term_rows(requests, "query"))
    assert [h for h in hits(spark, only) if h[0] in QUERIES] == [h for h in expected if h[0] in QUERIES]


def test_statistics_equal_a_rebuild(spark, changed):
    path, live = changed
    rounded = ["field", "term", "df", F.round("idf", 9)]
    expected = build_index(live, "movie_id", FIELDS).terms
    assert rows(term_statistics(spark, path).select(*rounded)) == rows(expected.select(*rounded))


def test_merged_segments_give_the_same(spark, changed):
    path, live = changed
    before = hits(spark, open_index(spark, path), 3)
    old = current(spark, path)
    assert len(old.parts) == 4 and len(compact(spark, path).parts) == 1
    assert hits(spark, open_index(spark, path), 3) == before
    # A reader that began before sees its own version still.
    assert hits(spark, open_index(spark, path, version=old), 3) == before


def test_everything_removed(spark):
    path = scratch_path(spark, "index")
    add_documents(spark.createDataFrame(make_docs(9), SCHEMA), "movie_id", FIELDS, path)
    remove_documents(spark, path, spark.range(9).select(F.col("id").alias("doc_id")))
    assert hits(spark, open_index(spark, path)) == []
    assert term_statistics(spark, path).count() == 0
    unchanged = remove_documents(spark, path, spark.createDataFrame([(1,)], "doc_id int"))
    assert unchanged == current(spark, path)


def test_nothing_indexed(spark):
    assert hits(spark, open_index(spark, scratch_path(spark, "index"))) == []


def test_text_ids_and_requests(spark):
    path = scratch_path(spark, "index")
    docs = spark.createDataFrame([("b", "red gear"), ("a", "red gear"), ("c", "blue")], "id string, title string")
    add_documents(docs, "id", ["title"], path)
    requests = spark.createDataFrame([(1, "gear"), (2, None), (3, "green")], "request_id int, query string")
    found = search(requests, "request_id", "query", open_index(spark, path), 5)
    assert rows(found, "request_id", "doc_id", "rank") == [(1, "a", 1), (1, "b", 2)]


LISTS = "user_id int, recommendations array<struct<movie_id:int,rating:float>>"


def lists_of(spark, users):
    return spark.createDataFrame([(u, [(u * 10, 1.0)]) for u in users], LISTS)


def test_lookups_join_without_a_shuffle_of_the_table(spark):
    path = scratch_path(spark, "lists")
    publish_version(lists_of(spark, range(300)), path, buckets=6)
    requests = spark.createDataFrame([(i * 7,) for i in range(60)], "user_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = published_lists(spark, path).join(requests, "user_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert joined.count() == 43
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_failed_write_leaves_the_old_version(spark):
    path = scratch_path(spark, "lists")
    publish_version(lists_of(spark, range(5)), path, buckets=2)
    broken = lists_of(spark, range(9)).withColumn(
        "user_id", F.when(F.col("user_id") == 7, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("user_id"))
    )
    with pytest.raises(Exception, match="lost"):
        publish_version(broken, path, buckets=2)
    assert current(spark, path).version == 1
    assert published_lists(spark, path).count() == 5
    publish_version(lists_of(spark, range(8)), path, buckets=3)
    assert current(spark, path).version == 2 and published_lists(spark, path).count() == 8


def test_a_commit_in_between_is_refused(spark):
    path = scratch_path(spark, "lists")
    since = current(spark, path)
    publish_version(lists_of(spark, range(5)), path, buckets=2)
    with pytest.raises(RuntimeError, match="was committed since"):
        snapshots.commit(spark, path, since, ["parts/lists-2-x"])
    assert published_lists(spark, path).count() == 5


def test_nothing_published(spark):
    assert published_lists(spark, scratch_path(spark, "lists")).count() == 0
