"""Repeated scorings, stored scores and lessons: what agrees, what must be done anew, what is promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ACCEPT, band_index, band_of


def duplicate_control(rows: DataFrame, key: str, score: str, grade: str, spread_max: int = ACCEPT) -> DataFrame:
    """(key, spread, bands, crossings, grades, status) of repeated scorings: pass, placement (one edge crossed or a wide
    spread, but the same reasoning) or fail."""
    r = rows.select(key, F.col(score).alias("s"), band_index(band_of(score)).alias("b"), F.col(grade).alias("g"))
    out = r.groupBy(key).agg((F.max("s") - F.min("s")).alias("spread"), F.count_distinct("b").alias("bands"), (F.max("b") - F.min("b")).alias("crossings"), F.count_distinct("g").alias("grades"), F.count("s").alias("_n"))
    bad = (F.col("_n") < 2) | (F.col("grades") > 1) | (F.col("crossings") > 1)
    status = F.when(bad, "fail").when((F.col("spread") <= spread_max) & (F.col("crossings") == 0), "pass").otherwise("placement")
    return out.withColumn("status", status).drop("_n")


def recompute_plan(now: DataFrame, stored: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """(key, action): no stored score, the first input whose digest changed, or reuse."""
    old = stored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in inputs])
    joined = now.join(old, F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "no stored score")
    for c in inputs:
        action = action.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"material input changed: {c}")
    return joined.select(key, action.otherwise("reuse").alias("action"))


def quality_gate(*failures: DataFrame) -> DataFrame:
    """(passed, n_failures) over frames of (key, failure)."""
    every = failures[0].select("key", "failure")
    for f in failures[1:]:
        every = every.unionByName(f.select("key", "failure"))
    return every.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("n_failures"))


def promoted(rows: DataFrame, lesson: str, application: str, confirmed: str, least: int = 2) -> DataFrame:
    """Lessons that were confirmed, or seen in so many different applications."""
    out = rows.groupBy(lesson).agg(F.count_distinct(application).alias("applications"), F.bool_or(confirmed).alias("confirmed"))
    return out.where(F.col("confirmed") | (F.col("applications") >= least))


def append_once(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ledger and the new rows whose key it has not: appending twice is appending once."""
    return ledger.unionByName(new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti"))


def provenance(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All keys with their newest record; a replaced score stays as previous_score."""
    old = stored.select(key, F.col("score").alias("_old"))
    both = fresh.select(key, "score").join(old, key, "full_outer")
    replaced = F.col("score").isNotNull() & F.col("_old").isNotNull() & (F.col("score") != F.col("_old"))
    return both.select(key, F.coalesce("score", "_old").alias("score"), F.when(replaced, F.col("_old")).alias("previous_score"))
