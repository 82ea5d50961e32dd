"""The capture log as a stream: the same states, kept by Spark's own aggregation, and counts over event time."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import log

#: Keys whose state outgrows a heap stay on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states(events: DataFrame) -> DataFrame:
    """The log's states over a stream of events; write it in update or complete mode.

    The picks are combinable minima and maxima, so the state of a posting is one row however many its events are, and
    the result is that of the batch form over the same events in any order of arrival that seq tells."""
    return log.state(events)


def distinct_events(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (key, fetched_at, url) once, within a lateness that bounds what is remembered."""
    return events.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["key", "fetched_at", "url"])


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """(start, n, n_ok) of tumbling or sliding windows of event time; later events than lateness are left out."""
    window = F.window("fetched_at", width, slide) if slide else F.window("fetched_at", width)
    out = events.withWatermark("fetched_at", lateness).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"))
    return out.select(F.col("w.start").alias("start"), "n", "n_ok")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of a key's events with no longer gap."""
    out = events.withWatermark("fetched_at", lateness).groupBy("key", F.session_window("fetched_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@contextlib.contextmanager
def _store(spark: SparkSession):
    name, wanted = STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def advance(spark: SparkSession, source: str, schema: T.StructType, folder: str, files: int = 0) -> None:
    """Takes the events files of source that no earlier call with this folder took into the log's states.

    files bounds the files of a micro-batch (0: all at once). A micro-batch writes the states that it changed under its
    own number, over what a lost try of the same number left, so a start after a stop anywhere goes on where the
    checkpoint stands and no event counts twice."""
    stream = spark.readStream.schema(schema)
    events = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    with _store(spark):
        started = states(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        started.trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The states as they stand after all calls of advance: of each key the row of the last micro-batch that changed it."""
    rows = spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states")
    names = [c for c in rows.columns if c not in ("key", "batch")]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("key", *[F.col(f"s.{c}").alias(c) for c in names])
