"""Every registered query equals its SQL twin on the smallest data set."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, queries
from entry_queries import ORACLES, QUERIES
from tests.conftest import DATA


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def canonical(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in values)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_no_query_lacks_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    frame = queries()[name](spark, DATA)
    result = database.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(frame.columns, frame.collect()) == canonical(columns, result.fetchall())


def test_entry_returns_every_film(spark):
    assert entry(spark).count() == 200
