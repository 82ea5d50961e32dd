"""Queries with SQL agree with it at the smallest scale."""

import os

import duckdb
import pytest

from lodestack.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLES[name]).df()
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns)
    assert sorted(map(str, a.itertuples(index=False, name=None))) == sorted(map(str, b.itertuples(index=False, name=None)))
