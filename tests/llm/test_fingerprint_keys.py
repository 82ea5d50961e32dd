"""Rows of one id and rows without one are cut into several ranges, and neighbours stay neighbours."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import fingerprint


@pytest.mark.parametrize("hot", [7, None])
def test_hot_ids_are_cut(spark, hot):
    spark_rows = [(hot, f"hot text number {i} {i * i}") for i in range(300)] + [(i, f"other {i}") for i in range(100)]
    docs = spark.createDataFrame(spark_rows, "doc_id long, text string")
    dealt = fingerprint.next_to_each_other(docs).where("NOT last").withColumn("part", F.spark_partition_id())
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) <= 150
    tie = {r["text"]: r["t"] for r in docs.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(spark_rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = {}
    for (_, a), (_, b) in zip(order, order[1:] + order[:1]):
        want[hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()] = len(a)
    got = {r["edited_sha256"]: r["n_chars"] for r in fingerprint.compare_neighbours(docs).collect()}
    assert got == want


def test_every_long_id_has_its_exact_next(spark):
    """Ids beyond what a double tells apart, both ends of the range, null and repeated ids: against a sort on the driver."""
    rng = random.Random(5)
    ids = [2**62 + i for i in range(900)] + [-(2**62) - 3 * i for i in range(300)] + [2**63 - 1, -(2**63), -(2**63), None, None, 0, 7, 7] + [2**60] * 200
    rows = [(i, f"text {k} " + "ab " * rng.randrange(5) + str(rng.random())) for k, i in enumerate(ids)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {r["text"]: r["t"] for r in frame.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    wanted = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        wanted.append((str(i), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    found = fingerprint.compare_neighbours(frame).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in found) == sorted(wanted)
