"""Every registered query against its plain SQL, at the smallest size."""

import functools
import math

import duckdb
import pytest

import __spark_entry__ as contract
from workloads import oracles, queries
from workloads.fixtures import TABLES

QUERIES, ORACLES = queries.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def engine(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def scored_once():
    """The scored completions feed many reports: run the candidates once for all of them."""
    original = queries.scored
    queries.scored = functools.cache(original)
    yield
    queries.scored = original


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "~" if value is None else str(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, engine, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(comparable(r[c]) for c in columns) for r in df.collect())
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(comparable(row[i]) for i in places) for row in result.fetchall())
    assert found == expected
    assert found


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["difficulty"] for r in rows} == {"easy", "medium", "hard", "extra", "unknown"}
