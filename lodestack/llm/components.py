"""Connected components of an edge table by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

#: Rows of one key that a task may take before the key is dealt out, at least.
HOT = 256


def spread_join(rows: DataFrame, table: DataFrame, key: str, own: str, total: int) -> DataFrame:
    """rows (total of them, about) with the row of table whose own is their key; own is unique in table.

    A key that more than a fourth of a task's rows have is dealt out: its rows by a hash of themselves, and the table's
    row once a share. There are at most four such keys a partition, so they may be broadcast."""
    share = max(HOT, total // (4 * partitions(rows.sparkSession)))
    hot = rows.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / share).cast("int").alias("_s")).where("_s > 1")
    left = rows.join(F.broadcast(hot), rows[key] == F.col("_k"), "left").drop("_k")
    left = left.withColumn("_at", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_s", F.lit(1))).cast("int")).drop("_s")
    right = table.join(F.broadcast(hot), table[own] == F.col("_k"), "left").drop("_k")
    right = right.withColumn("_to", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    return left.join(right, (left[key] == right[own]) & (F.col("_at") == F.col("_to"))).drop("_at", "_to")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    At first every a is linked to its least b alone, and its other b's to that one: the same components by fewer
    edges, as many a's share their b's. An a may have some b's, a b any number of a's.

    Each round a node takes the least label among its neighbours' and then the label of that label, so labels run
    along paths that double. Minima are combined before the shuffle, and joins deal out hubs and labels that many
    nodes have, so neither costs a task more than its share. Every round is a written table; the loop ends when no
    label changes."""
    starred = work.table(f"{name}-stars", edges.where("a <> b").select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m")))
    fewer = starred.select("a", F.col("m").alias("b")).unionByName(starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    both = work.table(f"{name}-edges", fewer.unionByName(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    labels, i = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), 0
    while True:
        i += 1
        heard = spread_join(both, labels, "b", "node", total).groupBy("a").agg(F.min("label").alias("heard"))
        low = work.table(f"{name}-low{i}", labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("low"), F.col("label").alias("old")))
        jump = low.select(F.col("node").alias("_n"), F.col("low").alias("_l"))
        new = work.table(f"{name}-{i}", spread_join(low, jump, "low", "_n", total).select("node", F.least("low", "_l").alias("label"), "old"))
        work.drop(f"{name}-low{i}")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
