"""Numbers in a global order without a global window."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows as a table in the session's shared checkpoint folder; without one, only a local master gets a folder."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or f"{tempfile.gettempdir()}/lodestack-checkpoints")
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with name: 1, 2, … in a global order.

    Ranges are sorted where they are; only their sizes, one number a partition, reach the driver and become offsets.
    The sorted rows are checkpointed, as ranges are drawn anew whenever they are computed."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(total)]
        total += sizes[p]
    before = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return placed.withColumn(name, (before + F.col("_at") + 1).cast("long")).drop("_part", "_at")


_MADE: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, deleted when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(found or f'file://{tempfile.gettempdir()}/lodestack-checkpoints').rstrip('/')}/lodestack-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _release() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
