"""Gates, anchors, question classes and small rules over authored rows and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import miners, scores
from ..functions import text as T
from ..operators import gates, review, tracker
from .registry import case, query, read, values

GOOD = "\n".join(f"{label}: x" for label in gates.CAPTURE_LABELS)
BODY = "About the role. " + "Responsibilities and more words here. " * 25
CAPTURES = [
    ("acme__pm.txt", f"{GOOD}\n{gates.START}\n{BODY}\n{gates.END}", ""), ("Acme PM.txt", f"{GOOD}\n{gates.START}\nshort\n{gates.END}", "filename not canonical; body too short; body has no structure"),
    ("a__b.txt", GOOD.replace("Company: x\n", "") + f"\n{gates.START}\n{BODY}\n{gates.END}", "missing label Company"), ("a__c.txt", GOOD.replace("Role: x", "Role: "), "body marks missing; blank Role"),
    ("a__d.txt", GOOD.replace("Base Salary: x", "Base Salary: Employer did not mention") + f"\n{gates.START}\n{BODY} Base pay range is $150K.\n{gates.END}", "false absence of pay"),
]


@case(values([(f, p) for f, _, p in CAPTURES], "filename, problems"))
def capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN33: contracts that captures break."""
    rows = spark.sql(f"SELECT * FROM {values([(f, t) for f, t, _ in CAPTURES], 'filename, text')}")
    return rows.select("filename", F.array_join(gates.capture_problems("text", "filename"), "; ").alias("problems"))


OUTPUTS = [("a", "# One\nx\n## Two\ny\n# Skills\n" + ", ".join(f"s{i}" for i in range(13))), ("b", "# Two\n# One\n# Skills\na, b"), ("c", "nothing")]


@case(values([("b", "out of order two"), ("b", "too few skills"), ("c", "missing one"), ("c", "missing two"), ("c", "missing skills")], "k, problem"))
def output_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN35: headings and skills of Markdown outputs."""
    return gates.output_problems(spark.sql(f"SELECT * FROM {values(OUTPUTS, 'k, text')}"), ["One", "Two", "Skills"], "k")


ANCHORS = [("a", "direct", 75, "68-81", "pass"), ("b", "light", 75, "68-81", "reasoning_mismatch"), ("c", "direct", 81, "68-81", "range_violation"), ("d", "direct", 67, "68-81", "pass")]


@case(values([(r[0], r[4]) for r in ANCHORS], "job_key, status"))
def anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN32, JOIN09: results against what calibration expects; an anchor without a result is ignored."""
    rows = spark.sql(f"SELECT * FROM {values([r[:4] for r in ANCHORS], 'job_key, grade, score, want')}")
    central = F.struct(F.lit("r").alias("requirement"), F.lit("thesis-defining").alias("classification"), F.col("grade"), F.lit("e").alias("evidence"))
    results = rows.select("job_key", "score", F.struct(F.array(central).alias("centrals"), F.lit(False).alias("compounding_applied")).alias("ledger"))
    expected = F.struct(
        F.col("want").alias("expected_band"), F.array(F.lit(65), F.lit(80)).alias("accepted_range"), F.lit(None).cast("int").alias("operating_range_min"), F.lit(None).cast("int").alias("operating_range_max"),
        F.lit("direct").alias("expected_pivotal_grade"), F.array().cast("array<string>").alias("expected_pivotal_grade_allowed"), F.lit(None).cast("string").alias("min_thesis_defining_grade"),
        F.lit(None).cast("boolean").alias("expected_compounding"), F.lit(True).alias("boundary_straddle_allowed"),
    )
    anchors = rows.select("job_key", expected.alias("anchor")).unionByName(rows.limit(1).select(F.lit("zz").alias("job_key"), expected.alias("anchor")))
    return gates.anchor_checks(results, anchors, "ledger", "score")


@query("""
SELECT count(*) = 0 AS passed, count(*)::BIGINT AS n_failures FROM (
  SELECT doc_id FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1)
""")
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: a batch passes if no rule found a failure."""
    labels = read(spark, sf_dir, "labels").withColumn("key", F.col("doc_id").cast("string"))
    bad = lambda c, m: labels.where(c).select("key", F.lit(m).alias("failure"))
    return review.quality_gate(bad("quality NOT IN (0, 1)", "quality"), bad("toxic = 1 AND quality = 1", "toxic"))


ASKED = [("a", "Why us?", "logistical"), ("a", "Describe a win", "substantive"), ("b", "Email", "standard"), ("b", "Notice period", "logistical")]


@case(values(ASKED, "file, label, class"))
def manifest_question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN08: classes from the manifest, else by wording."""
    rows = spark.sql(f"SELECT * FROM {values([a[:2] for a in ASKED], 'file, label')}")
    return gates.question_classes(rows, spark.sql(f"SELECT * FROM {values([('a', 'why us? ', 'logistical')], 'file, label, class')}"))


TITLES = [("Meta Careers", True), ("Careers at Acme", True), ("Jobs search results", True), ("PM, Careers Platform Experience", False), ("job details", True), ("Staff Engineer", False), ("", True)]


@case(values([(i, b) for i, (_, b) in enumerate(TITLES)], "pos, branding"))
def branding_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT06: titles that name a site and no role."""
    generic, nav = ["job details", "open positions", "job search"], ["job", "jobs", "search", "results", "careers", "open", "roles", "view", "all"]
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(TITLES)], 'pos, t')}").select("pos", miners.branding_only("t", generic, nav).alias("branding"))


@query("""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'attention' ELSE 'benign' END AS category, count(*)::BIGINT AS n,
       array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS names FROM orders GROUP BY 1
""")
def completeness_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09, FLT12: rows by category of completeness with their names."""
    label = F.expr("CASE o_orderstatus WHEN 'F' THEN '✓ complete' WHEN 'O' THEN '⚠ comp not verified' ELSE 'comp not posted' END")
    return tracker.attention(read(spark, sf_dir, "orders").withColumn("label", label), "o_orderpriority", "label")


@query("SELECT p_partkey, regexp_extract(p_name, '^(\\w+)', 1) AS first_word, len(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')))::INTEGER AS n FROM part")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG05: words of part names, each once in any case."""
    from ..operators.matching import distinct_first

    words = F.regexp_extract_all("p_name", F.lit("([A-Za-z]+)"))
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_name", r"^(\w+)", 1).alias("first_word"), F.size(distinct_first(words)).alias("n"))


@query("""
WITH old AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 = 0), new AS (SELECT c_custkey AS k, c_nationkey + 1 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)
""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC08: rows join a ledger only under keys that it has not."""
    c = read(spark, sf_dir, "customer")
    row = lambda m, d: c.where(f"c_custkey % {m} = 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + d).alias("v"))
    return review.append_once(row(3, 0), row(2, 1), "k")


@query("""
WITH old AS (SELECT s_suppkey AS k, s_nationkey AS score FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 5 ELSE s_nationkey END AS score FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(new.k, old.k) AS k, coalesce(new.score, old.score) AS score, coalesce(CASE WHEN new.score <> old.score THEN old.score END, -1) AS previous_score FROM old FULL JOIN new ON old.k = new.k
""")
def score_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: newest scores, with the one that each replaced (-1 for none)."""
    s = read(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("score"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 5 ELSE s_nationkey END").alias("score"))
    return review.provenance(old, new, "k").withColumn("previous_score", F.coalesce("previous_score", F.lit(-1)))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'b' ELSE '' END AS base FROM customer
""")
def targeted_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK08: cells of matching rows are replaced, a missing column is made."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    u = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment"), F.lit("b").alias("base"))
    return tracker.update_rows(c, u, "c_custkey")


TRACKED = [("apply asap high prio", "Work Tools", "New York hybrid", "$120K-$150K", ""), ("Down: Ruled Out", "Health - x", "Remote", "120-150", "2026-01-01")]


@case(values([("Apply ASAP: High Prio", "Work", "IRL NYC - unknown days", "120-150", "Unknown", 5), ("Down: Ruled Out", "Health - x", "Remote", "120-150", "2026-01-01", 0)], "status, lane, place, pay, day, repaired"))
def tracker_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: governed cells repaired, and how many changed."""
    names = ["Status? [You Change]", "Lane", "Working Location", "Comp Range", "Posting Last Update"]
    rows = spark.sql(f"SELECT * FROM {values(TRACKED, 'a, b, c, d, e')}").toDF(*names)
    return tracker.normalize(rows).toDF("status", "lane", "place", "pay", "day", "repaired")


FITS = [("Primary (high)", "Primary", "high", ""), ("Growth PM (medium) · +Platform", "Growth PM", "medium", "Platform"), ("Outside lanes (low)", "Outside lanes", "low", "")]


@case(values([(i, *f[1:]) for i, f in enumerate(FITS)], "pos, lane, confidence, second"))
def lane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC05: the grammar of lane fits."""
    rows = spark.sql(f"SELECT * FROM {values([(i, f[0]) for i, f in enumerate(FITS)], 'pos, t')}")
    return rows.select("pos", *[scores.lane_fit("t")[n].alias(n) for n in ("lane", "confidence", "second")])


@query("SELECT l_orderkey, l_linenumber, (l_quantity BETWEEN 1 AND 5 AND l_quantity = floor(l_quantity)) AS valid FROM lineitem")
def rubric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC10: whole scores of 1 to 5."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.rubric_valid("l_quantity").alias("valid"))


@query("""
SELECT s_suppkey, CASE WHEN a = b THEN false ELSE abs(a - b) = 1 END AS adjacent FROM (SELECT s_suppkey, CASE WHEN s >= 97 THEN 5 WHEN s >= 82 THEN 4 WHEN s >= 68 THEN 3 WHEN s >= 50 THEN 2 WHEN s >= 30 THEN 1 ELSE 0 END AS a,
  CASE WHEN t >= 97 THEN 5 WHEN t >= 82 THEN 4 WHEN t >= 68 THEN 3 WHEN t >= 50 THEN 2 WHEN t >= 30 THEN 1 ELSE 0 END AS b FROM (SELECT s_suppkey, s_suppkey % 101 AS s, s_nationkey * 4 AS t FROM supplier))
""")
def adjacent_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN05: whether two scores stand in neighbouring bands."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", scores.bands_adjacent(scores.band_of(F.col("s_suppkey") % 101), scores.band_of(F.col("s_nationkey") * 4)).alias("adjacent"))


@query("SELECT r_regionkey, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS pretty FROM region")
def pretty_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16: names out of slugs."""
    return read(spark, sf_dir, "region").select("r_regionkey", T.prettify_slug(F.regexp_replace(F.lower("r_name"), " ", "-")).alias("pretty"))
