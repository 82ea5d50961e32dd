"""Every registered query with SQL agrees with it at the smallest scale."""

import os

import duckdb
import pytest

from lodestack.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_written_cases(spark, duck, name):
    f, sql = registry.CASES[name]
    assert rows(f(spark, DATA).toPandas()) == rows(duck.execute(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 5
