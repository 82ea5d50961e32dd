"""The session that the library is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestack", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the options given; keys are written with __ for dots."""
    builder = SparkSession.builder.appName(name)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (own | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
