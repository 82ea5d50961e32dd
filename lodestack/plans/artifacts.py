"""Names and file listings over authored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import artifacts
from .registry import case, query, read, values

COMPANIES = [
    ("Teladoc Health, Inc.", "At Teladoc Health we care. Teladoc Health grows.", "Teladoc Health"), ("Chambercardio", "Chamber is here. Join Chamber today.", "Chamber"), ("Tryprofound", "Profound leads. We at Profound.", "Profound"),
    ("Grindr LLC", "", "Grindr"), ("Pike13 (Jonas Software)", "", "Pike13 (Jonas Software)"), ("Profound (Tryprofound)", "x", "Profound"), ("Headlight.health", "Headlight works. Headlight helps.", "Headlight"), (None, "x", ""),
]
BRANDS = [("betterup", "BetterUp helps. At BetterUp we", "BetterUp"), ("acme", "Acme is Acme", None), ("openai", "we at OpenAI", "OpenAI"), ("Two Words", "TwoWords", None), ("listenhq", "Listen and ListenHQ and ListenHQ", "ListenHQ"), ("iheartmedia", "iHeartMedia", "iHeartMedia"), ("shout", "SHOUT", None), ("x", None, None)]


@case(values([(i, c[2], b[2]) for i, (c, b) in enumerate(zip(COMPANIES, BRANDS))], "pos, shown, brand"))
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ08, PRJ09: companies as their postings write them."""
    rows = spark.sql(f"SELECT * FROM {values([(i, c[0], c[1], b[0], b[1]) for i, (c, b) in enumerate(zip(COMPANIES, BRANDS))], 'pos, c, body, t, said')}")
    return rows.select("pos", names.display_name("c", "body").alias("shown"), names.brand_casing("t", "said").alias("brand"))


BASES = [
    ("Globex - Sr. PM, Consumer (07-17-26)", "Globex - Sr. PM, Consumer (7/17/26)"), ("Stark — Staff PM (6/9/26), merged with the Hooli module", "Stark - Staff PM (6/9/26)"), ("Dropbox Principal PM — Teams (Jan 2026)", "Dropbox Principal PM - Teams (1/26)"),
    ("**Primary base:** Acme — Product Manager, copied and renamed", "Acme - PM"), ("- Base used: Acme. Then more", "Acme"), ("", ""),
]
LINKED = [("PM, Growth | https://a.com/x", "PM, Growth", "https://a.com/x"), ("PM only", "PM only", None), ("A | B | http://c.d", "A | B", "http://c.d"), ("https://only.link", "https://only.link", "https://only.link"), ("", "", None), (None, "", None)]


@case(values([(i, b[1], t[1], t[2]) for i, (b, t) in enumerate(zip(BASES, LINKED))], "pos, base, title, url"))
def tracker_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13, PRJ14: bases in short, and cells of title and link."""
    rows = spark.sql(f"SELECT * FROM {values([(i, b[0], t[0]) for i, (b, t) in enumerate(zip(BASES, LINKED))], 'pos, b, t')}")
    link = names.title_link("t")
    return rows.select("pos", names.terse_base("b").alias("base"), link["title"].alias("title"), link["url"].alias("url"))


BANDS = [
    ("Pay Range: USD 232,000–282,000", "$232-282K"), ("New York Pay Range: $160,000 - $230,000", "New York: $160-230K"), ("San Francisco Annual Base Salary Range: $170,000 - $210,000", "San Francisco: $170-210K Annually"), ("$236K – $296K · $213K – $266K", "$236-296K | $213-266K"),
    ("$182,500 per year", "$182.5K per year"), ("EUR 80,000 - 90,000", "EUR 80,000 - 90,000"), ("For work in New York City, Seattle, WA, the base salary range is $150,000 - $160,000", "NYC, Seattle, and WA: $150-160K"), ("", ""),
]
SHOWN = [
    ("New York City; San Francisco", "NYC or SF"), ("San Francisco, CA, New York, NY", "SF or NYC"), ("Remote - United States; Remote - New York; SF - Hybrid", "Remote (US; NYC) or IRL SF"), ("Remote", "Remote"), ("Austin, TX", "Austin"), ("NYC; New York, NY", "NYC"), ("", ""), ("Berlin", "Berlin"),
]


@case(values([(i, b[1], s[1]) for i, (b, s) in enumerate(zip(BANDS, SHOWN))], "pos, bands, places"))
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17, FN22: bands of pay and lists of places as people read them."""
    rows = spark.sql(f"SELECT * FROM {values([(i, b[0], s[0]) for i, (b, s) in enumerate(zip(BANDS, SHOWN))], 'pos, b, s')}")
    return rows.select("pos", F.array_join(names.salary_bands("b"), " | ").alias("bands"), names.display_locations("s").alias("places"))


WISHES = [("We have a strong preference for someone based in San Francisco or New York City. More.", "Strong preference for someone based in SF or NYC."), ("Must live in Austin", None), ("", None)]


@case(values([(i, b) for i, (_, b) in enumerate(WISHES)], "pos, said"))
def location_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23: a preference of place that a text states."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(WISHES)], 'pos, t')}").select("pos", names.preference("t").alias("said"))


LISTED = [("https://acme.com/careers/jobs?gh_jid=123", "123", True), ("https://acme.com/jobs/123?gh_jid=123", "123", False), ("https://acme.com/about?gh_jid=123", "123", False), ("", "123", False)]


@case(values([(i, r[2]) for i, r in enumerate(LISTED)], "pos, listing"))
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT07: application addresses that only list postings."""
    return spark.sql(f"SELECT * FROM {values([(i, *r[:2]) for i, r in enumerate(LISTED)], 'pos, u, n')}").select("pos", artifacts.listing_page("u", "n").alias("listing"))


CHANGED = [("docs/changelog.md",), ("scripts/doc_synthesis_core.py",), ("requirements.txt",), ("src/a.py",)]


@case(values([("src/a.py",)], "path"))
def meaningful_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10: changed files without self-maintenance."""
    return artifacts.meaningful_changes(spark.sql(f"SELECT * FROM {values(CHANGED, 'path')}"))



MOVES = [("f", "a.txt"), ("f", "b.md"), ("g", "a.txt"), ("g", "out/a.txt"), ("h", "b.md")]


@case(values([("f", "a.txt", "out/a.txt", "move"), ("f", "b.md", None, "keep"), ("g", "a.txt", "out/a.txt", "skip"), ("g", "out/a.txt", None, "skip"), ("h", "b.md", None, "keep")], "folder, path, target, action"))
def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13: moves of folders, none of one with a conflict."""
    target = F.when(F.col("path").rlike(r"^[^/]*\.txt$"), F.concat(F.lit("out/"), "path"))
    return artifacts.migration_plan(spark.sql(f"SELECT * FROM {values(MOVES, 'folder, path')}"), target)


@query("""
SELECT c_nationkey, sum((c_mktsegment = 'BUILDING')::INT) > 0 AND sum((c_mktsegment = 'MACHINERY')::INT) > 0 AND sum((c_mktsegment = 'NONE')::INT) = 0 AND count(*) FILTER (c_custkey % 50 = 3) = 1 AND true AS ready FROM customer GROUP BY c_nationkey
""")
def reconcile_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC07: nations as folders, their customers as files of kinds."""
    c = read(spark, sf_dir, "customer")
    kinds = c.select("c_nationkey", F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'output' WHEN 'MACHINERY' THEN 'posting' ELSE 'other' END").alias("kind"))
    more = c.where("c_custkey % 50 = 3").select("c_nationkey", F.lit("final-pdf").alias("kind")).unionByName(c.select("c_nationkey", F.lit("archived").alias("kind")).distinct())
    return artifacts.ready(kinds.unionByName(more), "c_nationkey").select("c_nationkey", "ready")
