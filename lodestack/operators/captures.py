"""Captures: classification, first-wins dedupe, manifests that carry forward, attempts, soft duplicates and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import col, hits, strip
from .order import numbered


def classify(body, is_ats=None, content=None, structure=None, shell=None, least: int = vocab.THIN_CHARS, quorum: int = vocab.LOOSE_QUORUM) -> Column:
    """(status, reason) of a body: empty fails, a tracking system is trusted, then shells, short ones, ones without a
    content marker and ones without a section or enough markers are thin. Marker lists may be given."""
    content, structure, shell = content or vocab.CONTENT, structure or vocab.STRUCTURE, shell or vocab.SHELL
    text = strip(body)
    low = F.lower(text)
    trusted = F.lit(False) if is_ats is None else F.coalesce(col(is_ats), F.lit(False))
    loose = hits(low, content)
    thin = lambda why: F.struct(F.lit("thin").alias("status"), F.lit(why).alias("reason"))
    fine = F.struct(F.lit("usable").alias("status"), F.lit("").alias("reason"))
    return (
        F.when(text == "", F.struct(F.lit("failed").alias("status"), F.lit("empty").alias("reason"))).when(trusted, fine)
        .when((hits(low, shell) > 0) & (loose == 0), thin("shell")).when(F.length(text) < least, thin("short"))
        .when(loose == 0, thin("no content marker")).when((hits(low, structure) == 0) & (loose < quorum), thin("no section"))
        .otherwise(fine)
    )


def structured_source(source, flag=None) -> Column:
    """A flag where given, else whether the source is more than a plain page."""
    plain = F.lower(strip(source)).isin("requests/html", "playwright/html")
    return F.coalesce(*([col(flag)] if flag is not None else []), ~plain)


def first_wins(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """rows with is_duplicate and duplicate_of: the value of the first row with the same key, by pos.

    A window a key: partial minima first, so that a hot key's rows never gather in one task."""
    firsts = rows.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))).alias("_f"))
    joined = rows.join(firsts, F.col(key).eqNullSafe(F.col("_k")), "left")
    later = F.col("_f.p") < F.col(pos)
    return joined.withColumn("is_duplicate", later).withColumn("duplicate_of", F.when(later, F.col("_f.v"))).drop("_k", "_f")


def status_counts(rows: DataFrame, status: str = "status", statuses: list[str] | None = None) -> DataFrame:
    """(status, n) with a row for every known status, 0 where none has it."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(s,) for s in statuses or vocab.STATUSES], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def carry_forward(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """current, and what previous had under keys that current has not; null keys match no row."""
    return current.unionByName(previous.join(current.select(key).distinct(), key, "left_anti"))


def plan_run(entries: DataFrame, previous: DataFrame, key: str, force: bool = False) -> DataFrame:
    """entries with action: carry (usable before), retry (thin or failed before), fetch (new), all fetch when forced."""
    before = previous.select(F.col(key).alias("_k"), F.col("status").alias("_s")).dropDuplicates(["_k"])
    joined = entries.join(before, F.col(key) == F.col("_k"), "left")
    action = F.when(F.lit(force), "fetch").when(F.col("_s") == "usable", "carry").when(F.col("_s").isNotNull(), "retry").otherwise("fetch")
    return joined.withColumn("action", action).drop("_k", "_s")


def soft_duplicates(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """rows with duplicate_group: groups of more than one row with equal keys, numbered by first appearance from 1.

    Numbers go over groups, not rows: only one row a group is sorted, in ranges."""
    groups = rows.groupBy(*keys).agg(F.min(pos).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    renamed = numbered(groups, ["_first"], "duplicate_group").select(*[F.col(k).alias(f"_{k}") for k in keys], "duplicate_group")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])


def fold_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """The winning attempt of each key: (attempt, status, missing) in order of attempt.

    A later attempt replaces the winner so far if it improves the body's status, or is usable with strictly fewer
    missing fields. So the first attempt of the best status wins, and of usable ones the first with the fewest missing;
    one with an unknown number is replaced by none and replaces none. These are minima, so that a hot key's attempts
    never gather in one task."""
    rank = F.when(F.col("status") == "usable", 2).when(F.col("status") == "thin", 1).otherwise(0)
    tries = attempts.select(key, rank.alias("_r"), F.struct("attempt", "missing", "status").alias("_t"))
    firsts = [F.min(F.when(F.col("_r") == r, F.col("_t"))).alias(f"_{r}") for r in range(3)]
    fewest = F.min(F.when((F.col("_r") == 2) & F.col("_t.missing").isNotNull(), F.struct("_t.missing", "_t.attempt", "_t.status"))).alias("_f")
    best = tries.groupBy(key).agg(*firsts, fewest)
    part = lambda n: F.when(F.col("_2.missing").isNotNull(), F.col(f"_f.{n}")).otherwise(F.coalesce("_2", "_1", "_0")[n])
    return best.select(key, part("attempt").alias("attempt"), part("status").alias("status"), part("missing").alias("missing"))


def best_verified(new: DataFrame, old: DataFrame, key: str, regions: dict[str, list[str]]) -> DataFrame:
    """new rows, with the old body where the new one lost a region that the old one had, and old dates where lost."""
    names = ["body", "posted_date", "updated_date"]
    before = old.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in names])
    lost = F.lit(False)
    for words in regions.values():
        lost = lost | ((hits(F.lower(F.coalesce("_body", F.lit(""))), words) > 0) & (hits(F.lower(F.coalesce("body", F.lit(""))), words) == 0))
    joined = new.join(before, F.col(key) == F.col("_k"), "left").withColumn("kept_old_body", F.coalesce(lost, F.lit(False)))
    joined = joined.withColumn("body", F.when(F.col("kept_old_body"), F.col("_body")).otherwise(F.col("body")))
    for n in names[1:]:
        joined = joined.withColumn(n, F.coalesce(n, f"_{n}"))
    return joined.drop("_k", *[f"_{n}" for n in names])
