"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, restored, set_aside

#: Sources up to this many are broadcast after they were counted; more are joined by a salted shuffle.
BROADCAST_SOURCES = 4096
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, size) rows to source, source_size, target and rate.

    Sources stand by code point, null last, and weigh as weights say, over and over. They share share times
    all sizes; no target exceeds cap times its source's size, and what is over goes to the others by weight.
    With sources by how soon they reach their cap, the first that stays below it fixes the level of the rest,
    so one pass over the sources replaces the rounds of sharing out. A source of size 0 has target and rate 0.
    The two windows see one row a source: they hold what the aggregation left, never rows of documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = totals.select("source", "source_size", F.row_number().over(in_order).alias("place"))
    s = s.withColumn("w", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights)))))
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), "place")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("w").over(after))
    s = s.withColumn("least", F.max(F.when(F.col("source_size") * cap >= F.col("level") * F.col("w"), F.col("level"))).over(all_rows))
    limit = (F.col("source_size") * cap).cast("double")
    s = s.withColumn("target", F.least(limit, F.coalesce(F.col("least") * F.col("w"), limit)))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def with_rates(docs: DataFrame, sized: DataFrame, **how) -> DataFrame:
    """sized with source_size, target and rate of its rows' source; sized must have source, size and draw.

    The sources are aggregated with partial sums before any shuffle and written once. Where few enough, they are
    broadcast; else the rows go by source and a salt, each source standing once a salt."""
    spark = docs.sparkSession
    rates = Workspace(spark, "mix").table("rates", source_rates(docs.select("source", "size"), **how))
    if rates.count() <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(rates.withColumnRenamed("source", "_source")), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    left = sized.withColumn("_bin", F.floor(F.col("_draw") * SALTS).cast("int"))
    return left.join(salted, left["source"].eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_salt"))).drop("_source", "_salt", "_bin")


def plan_mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """docs with size, source_size, target, rate and copies: floor(rate) and one more by a hash-seeded coin.

    docs needs doc_id, text and source; all its other columns stay, and ones named as those above are replaced.
    Null or empty texts have size 0 and follow their source's rate; a null source is a source of its own.
    Repeated rows (same id, source and text) draw alike. An empty table gives an empty result."""
    own = docs.drop("size", "source_size", "target", "rate", "copies", "_draw", "_salt", "_bin", "_source")
    sized = own.withColumn("size", word_count(F.col("text"))).withColumn("_draw", draw(seed, F.col("doc_id"), F.col("source"), F.md5(F.col("text"))))
    stats = docs.select("source", word_count(F.col("text")).alias("size"))
    joined = with_rates(stats, sized, **how)
    copies = F.floor("rate") + F.when(F.col("_draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop("_draw")


def mix(docs: DataFrame, seed: int = 1, **how) -> DataFrame:
    """The mix itself: each document as often as plan_mix says, with the columns of docs."""
    used = ("doc_id", "text", "source")
    planned = plan_mix(set_aside(docs, used), seed, **how).where("copies > 0")
    return planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*restored(docs.columns, used))
