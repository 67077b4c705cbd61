"""The registered queries: SQL twins, and the pipeline against its stages done plainly."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from cinerank.llm.common import read_table
from cinerank.llm.mixing import mix_sources
from cinerank.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.llm.test_operators import components_of, lower
from tests.test_registry import canonical


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_all_are_registered():
    names = {name.split("_")[0] for name in QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, DATA)
    result = database.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(frame.columns, frame.collect()) == canonical(columns, result.fetchall())


# Spelling gives a row per word.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_spelling"}))
def test_query_covers_every_document(spark, name):
    frame = QUERIES[name](spark, DATA)
    ids = [r["doc_id"] for r in frame.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in read_table(spark, DATA, "documents").collect())


def test_pipeline_stages(spark):
    docs = read_table(spark, DATA, "documents").cache()
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, DATA, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]

    good = stages["quality"](spark, docs, DATA).cache()
    ids = {r["doc_id"] for r in good.collect()}
    assert all(labels.get(i, 1) == 1 for i in ids)
    assert all(i in ids for i, q in labels.items() if q == 1)

    single = stages["exact_dedup"](spark, good, DATA).cache()
    newest = {}
    for r in good.collect():
        newest[lower(r["text"])] = max(r["doc_id"], newest.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(newest.values())

    apart = stages["near_dedup"](spark, single, DATA).cache()
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    _, roots = components_of(rows, 5)
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted({root[0] for root in roots.values()})

    mixed = stages["mixing"](spark, apart, DATA).cache()
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(apart).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n}
    assert all(stage.columns == docs.columns for stage in (good, single, apart, mixed))

    tokens = stages["bpe"](spark, mixed, DATA)
    assert tokens.count() == mixed.count()
    assert tokens.filter("size(ids) <> n_tokens").count() == 0


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [
        (1, "Good words here and there", "en", "s", 1), (1, "Good words here and there", "en", "s", 1),
        (1, "other words for this id", None, None, None), (None, None, None, None, None),
        (None, "", "en", "s", 0), (2, "good WORDS here and there", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    single = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in single.filter("doc_id > 0").collect()) == [
        (1, "other words for this id"), (2, "good WORDS here and there"),
    ]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


CLASHING = "did long, tk long, stands string, several int, mark long, copies int, copy int, row string, _copies int"


def test_stages_keep_columns_with_clashing_names(spark):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    extra = (8, 7, "s", 6, 5, 4, 3, "r", 2)
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{body} {'abcde'[i % 5]}{i // 5}" * 3, "en", "st"[i % 2], i, *extra) for i in range(20)]
    rows += [(i, rows[3][1], "en", "s", i, *extra) for i in range(20, 24)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixing):
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        left = {tuple(r) for r in kept.collect()}
        assert left and left <= set(rows)


def test_stages_take_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).collect() == []


def test_one_of_each_group_stands(spark):
    """Equal and near texts without ids, and under one id; rows alike but for other columns."""
    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (20, 90, 150)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for doc_id in (None, 5):
        docs = spark.createDataFrame([(doc_id, t, "en", "s", 1) for t in near], schema)
        assert corpus_pipeline.near_dedup(spark, docs, DATA).count() == 1
        cased = [(doc_id, t, lang, "s", 1) for t in ("Same text", "same TEXT") for lang in ("en", "de", "fr")]
        docs = spark.createDataFrame(cased, schema)
        kept = [corpus_pipeline.exact_dedup(spark, docs.repartition(n), DATA).collect() for n in (1, 5)]
        assert kept[0] == kept[1] and len(kept[0]) == 1
