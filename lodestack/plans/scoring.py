"""Scores: comparisons, ledgers, duplicates, recomputation and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import review, tracker
from .registry import case, query, read, values

BLOCKS = [("", "", "", "", ""), ("70", "80", "", "", "half-written"), ("82", "85", "3", "why", "base not a multiple of 5; delta not a multiple of 5"), ("80", "75", "-5", "why", "improved below base; delta negative"), ("70", "80", "5", "why", "delta is not improved - base"), ("70", "80", "10", "", "reason missing"), ("70", "80", "10", "why", ""), ("x", "80", "10", "why", "base is not a whole number")]


@case(values([(i, b[4]) for i, b in enumerate(BLOCKS)], "pos, errors"))
def resume_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN28: what is wrong with a block of scores."""
    rows = spark.sql(f"SELECT * FROM {values([(i, *b[:4]) for i, b in enumerate(BLOCKS)], 'pos, a, b, c, d')}")
    return rows.select("pos", F.array_join(scores.comparison_errors("a", "b", "c", "d"), "; ").alias("errors"))



@query("""
WITH a AS (SELECT doc_id, sha256(text) AS p, sha256(source) AS c FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS p, sha256(CASE WHEN doc_id % 7 = 0 THEN 'y' ELSE source END) AS c FROM documents WHERE doc_id % 11 <> 0)
SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'no stored score' WHEN a.p <> b.p THEN 'material input changed: posting' WHEN a.c <> b.c THEN 'material input changed: card' ELSE 'reuse' END AS action
FROM a LEFT JOIN b USING (doc_id)
""")
def recompute_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN31: which documents must be scored again, by the first input whose digest changed."""
    docs = read(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("posting"), F.sha2("source", 256).alias("card"))
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END"), 256).alias("posting"), F.sha2(F.expr("CASE WHEN doc_id % 7 = 0 THEN 'y' ELSE source END"), 256).alias("card"))
    return review.recompute_plan(now, old, "doc_id", ["posting", "card"])


@query("""
SELECT rule, count(*)::BIGINT AS n FROM (
  SELECT 'quantity above 45' AS rule FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'discount above 9 %' FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'returned but open' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O') GROUP BY rule
""")
def integrity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: rows that break rules, by rule."""
    c = F.col
    rules = {"quantity above 45": c("l_quantity") > 45, "discount above 9 %": c("l_discount") > 0.09, "returned but open": (c("l_returnflag") == "R") & (c("l_linestatus") == "O")}
    return tracker.violations(read(spark, sf_dir, "lineitem"), rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey::VARCHAR AS "Job File", coalesce(o_orderpriority, '') AS "Lane", o_custkey::VARCHAR AS "Company", CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Unknown' END AS "Posting Last Update", '' AS "Comp Range" FROM orders
""")
def contract_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15, PRJ16: an old table's columns under the contract's names, two dates as one, missing ones blank."""
    o = read(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").cast("string").alias("Job File"), F.col("o_orderpriority").alias("Bucket"), F.col("o_custkey").cast("string").alias("Company"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("Unknown").alias("ATS First Posted Date"), F.lit("").alias("ATS Last Updated Date"), F.lit("x").alias("Location Fit"))
    new = tracker.migrate(old, ["Job File", "Lane", "Company", "Posting Last Update", "Comp Range"], {"Bucket": "Lane"}, ["Location Fit"])
    return new.select("Job File", "Lane", "Company", "Posting Last Update", "Comp Range")


LEDGERS = [
    ("a", "direct", 75, "68-81", False, "", "accept_primary"), ("b", "absent", 75, "68-81", False, "absent_thesis_central", "require_adjudication"),
    ("c", "light", 60, "50-67", True, "light_thesis_central_sub68; compounding", "require_adjudication"), ("d", "direct", 75, "50-67", False, "", "fail_incomplete"),
]


@case(values([(r[0], r[5], r[6]) for r in LEDGERS], "k, flags, decision"))
def ledger_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN29, FN30, AGG12: flags of ledgers and what a second pass (direct, 73, no compounding) decides."""
    rows = spark.sql(f"SELECT * FROM {values([r[:5] for r in LEDGERS], 'k, grade, score, band, comp')}")

    def ledger(grade, score, band, comp):
        central = F.struct(F.lit("ships products").alias("requirement"), F.lit("thesis-defining").alias("classification"), grade.alias("grade"), F.lit("did so").alias("evidence"))
        thesis, setter = F.lit("a product leader for growth").alias("hiring_thesis"), F.lit("ships products at scale").alias("band_setter")
        flags = [F.lit(False).alias(f) for f in ("hiring_thesis_ambiguous", "centrality_ambiguous", "independent_gap_ambiguity", "posting_requirement_conflict")]
        return F.struct(thesis, F.array(central).alias("centrals"), F.lit("coherent").alias("narrative_coherence"), F.lit("none found").alias("misclassification_check"), comp.alias("compounding_applied"), setter, band.alias("band"), score.alias("score"), *flags)

    rows = rows.withColumn("p", ledger(F.col("grade"), F.col("score"), F.col("band"), F.col("comp"))).withColumn("s", ledger(F.lit("direct"), F.lit(73), F.lit("68-81"), F.lit(False)))
    yes = F.lit(True)
    return rows.select("k", F.array_join(scores.deterministic_flags("p"), "; ").alias("flags"), scores.acceptance("p", "s", yes, yes, yes).alias("decision"))


@query("SELECT s_suppkey, CASE WHEN f >= 80 THEN 'Apply ASAP: High Prio' WHEN f >= 70 THEN 'Apply Eventually: Apply If Time' WHEN f >= 60 THEN 'Apply Eventually: Backup Lane' ELSE 'Apply Eventually: Or Skip It' END AS status FROM (SELECT s_suppkey, s_suppkey % 100 AS f FROM supplier)")
def initial_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC02: what a final score starts as."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", scores.first_status(F.col("s_suppkey") % 100).alias("status"))


COMPLETE = [("120-180", "Remote", "✓ complete"), ("??", "Unknown", "⚠ comp+location not verified"), ("", "Remote", "⚠ comp not verified"), ("120-180", "", "⚠ location unknown")]


@case(values([(i, c[2]) for i, c in enumerate(COMPLETE)], "pos, label"))
def completeness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN08: completeness by a row's own cells."""
    return spark.sql(f"SELECT * FROM {values([(i, *c[:2]) for i, c in enumerate(COMPLETE)], 'pos, a, b')}").select("pos", scores.fallback_completeness("a", "b").alias("label"))


@query("""
SELECT o_custkey, count(*)::BIGINT AS applications, bool_or(o_orderstatus = 'F') AS confirmed FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') OR count(DISTINCT o_orderkey) >= 2
""")
def lesson_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC09: lessons that were confirmed, or seen in two applications."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("confirmed"))
    return review.promoted(o, "o_custkey", "o_orderkey", "confirmed")
