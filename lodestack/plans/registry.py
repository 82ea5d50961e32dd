"""Every query of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "page_status_counts"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must agree with it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(sql: str):
    """Keeps a function over rows that someone wrote down, with what it must give: no query, but a test's vectors."""

    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out over three tasks a core: a small file is one task, however much work its rows are."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES table that Spark and other engines read alike; the text must hold no backslash."""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


from . import artifacts, captures, gates, landing, log, matching, mining, normalizers, recovery, revisions, scoring, sources, tables, whole, writing  # noqa: E402,F401  they register themselves
