"""Queries that SQL can express, against their SQL."""

import pytest

import __spark_entry__ as contract
from sqltally.llm.oracles import ORACLES
from sqltally.llm.queries import QUERIES


def comparable(value):
    return "~" if value is None else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, engine, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(comparable(r[c]) for c in columns) for r in df.collect())
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(comparable(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert found


def test_every_query_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
