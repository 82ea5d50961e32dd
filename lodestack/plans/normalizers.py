"""Normalisers on rows that tests give: places, pay, dates, roles, states, questions; and bands over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, pay, places, questions, scores
from ..functions import text as T
from ..operators import identity
from .registry import case, query, read, values

PLACE = {"home_metro": "New York City", "home_metro_aliases": ["NYC", "New York", "New York City", "Manhattan", "Brooklyn"], "city_priority": ["NYC", "SF"]}
LOCATIONS = [
    ("Remote", "Remote", "42FF35"), ("IRL NYC - 1 day", "IRL NYC - 1 day", "FDFF43"), ("IRL NYC/SF - 3 days", "IRL NYC - 3 days (or SF hub, 3 days)", "FDFF43"),
    ("IRL NYC - at least 3 days", "IRL NYC - 3+ days", "FA9C31"), ("IRL NYC - 4 days", "IRL NYC - 4 days", "FA9C31"), ("IRL SF - 3 days", "IRL SF - 3 days", "F82C1F"),
    ("New York hybrid", "IRL NYC - unknown days", "FA9C31"), ("IRL NYC - 2-3 days", "IRL NYC - 2-3 days", "FDFF43"), ("", "Unknown", "FA9C31"),
    ("Remote - US only", "Remote (US only)", "42FF35"), ("Fully remote", "Remote", "42FF35"), ("NYC, SF - 2 days", "IRL NYC - 2 days (or SF hub, 2 days)", "FDFF43"),
    ("Austin, TX or Denver, CO - 3 days", "IRL Austin/Denver - 3 days", "F82C1F"), ("Washington, D.C. - 2 days", "IRL DC - 2 days", "F82C1F"), ("see posting", "Unknown", "FA9C31"),
]


@case(values([(i, b, c) for i, (_, b, c) in enumerate(LOCATIONS)], "pos, location, color"))
def working_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN01, FN02, FN03, SRT04: location texts in the grammar, and their colours."""
    rows = spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _, _) in enumerate(LOCATIONS)], 'pos, t')}").withColumn("location", places.normalize_location("t", PLACE))
    return rows.select("pos", "location", places.location_color("location", PLACE).alias("color"))


RANGES = [("$125K–$250K", "125-250", "Near target"), ("125,000 - 250,000", "125-250", "Near target"), ("180", "180-180", "Near target"), ("150k to 190k", "150-190", "Near target"), ("??", "??", "Unknown"), ("$250K-$210K", "210-250", "Meets/above target"), ("a to b", "??", "Unknown"), ("120K-170K", "120-170", "Below floor"), (None, "??", "Unknown"), ("182.5K", "182-182", "Near target"), ("240-333", "240-333", "Top of market")]


@case(values([(i, b, c) for i, (_, b, c) in enumerate(RANGES)], "pos, pay, fit"))
def comp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN04, FN05: pay as ranges, and how they stand to floor 180, target 200 and top 300."""
    rows = spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _, _) in enumerate(RANGES)], 'pos, t')}").withColumn("pay", pay.normalize_range("t"))
    return rows.select("pos", "pay", pay.fit_label("pay", 180, 200, 300).alias("fit"))


@query("""
WITH l AS (SELECT l_partkey, min(l_extendedprice / 1000)::BIGINT AS lo, max(l_extendedprice / 1000)::BIGINT AS hi FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN hi < 30 THEN 'Below floor' WHEN hi > 90 THEN 'Top of market' WHEN (lo + hi) / 2 >= 40 THEN 'Meets/above target' ELSE 'Near target' END AS fit FROM l
""")
def comp_fit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN05: how a part's span of prices in thousands stands to floor 30, target 40 and top 90."""
    p = F.col("l_extendedprice") / 1000
    span = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bround(F.min(p)).cast("long").alias("lo"), F.bround(F.max(p)).cast("long").alias("hi"))
    return span.select("l_partkey", pay.fit_label(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")), 30, 40, 90).alias("fit"))


ENVELOPES = [
    ("Zone A: $200-250K · Zone B: $180-225K", "180-250"), ("$122.4-170K · $156.4-190K", "122-190"), ("Tier 1: $216-270K · Tier 2: $183.6-229.5K", "184-270"), ("USD 182,000-227,000", "182-227"),
    ("$200-250K · $27-44/hour", "200-250"), ("", ""), ("$181.9K/yr - $214K/yr", "182-214"), ("$150,000 per year - $180,000 per year", "150-180"), ("$60/hour - $80/hour", ""),
    ("139,764–287,749", "140-288"), ("$182.5K – $296.5K", "183-297"), ("$165K", "165-165"), ("$1.2M", ""),
]


@case(values([(i, b) for i, (_, b) in enumerate(ENVELOPES)], "pos, span"))
def comp_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG03, AGG04: the span of all annual bands of a text."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(ENVELOPES)], 'pos, t')}").select("pos", pay.envelope("t").alias("span"))


@query("""
WITH b AS (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_totalprice BETWEEN 10000 AND 2000000 GROUP BY o_custkey)
SELECT o_custkey, round(round(lo, 0)::DECIMAL(18, 6) / 1000, 0)::BIGINT || '-' || round(round(hi, 0)::DECIMAL(18, 6) / 1000, 0)::BIGINT AS span FROM b
""")
def order_price_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG03: the span of each customer's order prices, its two ends written as a band and read again."""
    whole = lambda c: F.format_number(F.round(c, 0), 0)
    o = read(spark, sf_dir, "orders").where("o_totalprice BETWEEN 10000 AND 2000000").groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    o = o.withColumn("t", F.concat(F.lit("$"), whole("lo"), F.lit(" - $"), whole("hi")))
    return o.select("o_custkey", pay.envelope("t").alias("span"))


DATES = [("2026-06-13T09:05:32-04:00", "2026-06-13"), ("1782932070272", "2026-07-01"), ("Posted 30 Days Ago", None), ("", None), ("2026-02-30", None), ("1782932070", "2026-07-01"), (None, None)]


@case(values([(i, b) for i, (_, b) in enumerate(DATES)], "pos, day"))
def posting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN09: plain dates of what systems write."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(DATES)], 'pos, t')}").select("pos", dates.posting_date("t").alias("day"))


@query("""
SELECT o_orderkey, CASE WHEN a < 0 THEN NULL WHEN a <= 7 THEN 'fresh' WHEN a <= 30 THEN 'recent' WHEN a <= 60 THEN 'aging' ELSE 'stale' END AS band
FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS a FROM orders)
""")
def recency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN04: how old orders are on a day."""
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.recency("o_orderdate", "1998-08-02").alias("band"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN q >= 85 THEN '85+' WHEN q >= 80 THEN '80-84' WHEN q >= 75 THEN '75-79' WHEN q >= 70 THEN '70-74' WHEN q >= 65 THEN '65-69' WHEN q >= 60 THEN '60-64' WHEN q >= 50 THEN '50-59' ELSE '<50' END AS part_band,
       CASE WHEN q >= 80 THEN '80+' WHEN q >= 70 THEN '70-79' WHEN q >= 60 THEN '60-69' ELSE '<60' END AS final_band,
       CASE WHEN q >= 97 THEN '97-100' WHEN q >= 82 THEN '82-96' WHEN q >= 68 THEN '68-81' WHEN q >= 50 THEN '50-67' WHEN q >= 30 THEN '30-49' ELSE '0-29' END AS profile_band
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q FROM lineitem)
""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN05: bands of doubled quantities as parts, finals and profile fits."""
    q = F.col("l_quantity") * 2
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.score_band(q).alias("part_band"), scores.final_band(q).alias("final_band"), scores.band_of(q).alias("profile_band"))


ROLES = [("Staff Product Manager - Referral, Growth", "Staff PM, Referral Growth"), ("Sr. Product Manager", "Senior PM"), ("Vice President of Product", "VP of Product"), ("PM: Growth/Retention", "PM, Growth Retention"), ("Chief Product Officer", "Chief Product Officer"), ("Staff PM, Referral Growth", "Staff PM, Referral Growth")]
LANES = [("Work Tools - Collaboration", "Work - Collaboration"), ("Work Tools", "Work"), ("Health - Consumer Mental Health", "Health - Mental Health"), ("Health-Provider Tools", "Health - Provider Tools"), ("Fintech Infrastructure", "Fintech Infrastructure"), ("other — x", "Other - x")]
STATES = [("apply asap high prio", "Apply ASAP: High Prio"), ("DOWN: ruled out", "Down: Ruled Out"), ("my own", "my own"), ("", ""), ("currently in talks", "**Currently In Talks**"), ("Apply Again", "Apply Again??")]


@case(values([(i, r[1], n[1], s[1]) for i, (r, n, s) in enumerate(zip(ROLES, LANES, STATES))], "pos, role, lane, state"))
def tracker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11, FN06, FN07: roles, lanes and states in their canonical form."""
    rows = spark.sql(f"SELECT * FROM {values([(i, r[0], n[0], s[0]) for i, (r, n, s) in enumerate(zip(ROLES, LANES, STATES))], 'pos, r, n, s')}")
    return rows.select("pos", scores.role_name("r").alias("role"), scores.normalize_lane("n").alias("lane"), scores.normalize_status("s").alias("state"))


ASKED = [
    ("Why do you want to work here?", "textarea", "q1", "substantive", True), ("First name", "text", "first_name", "standard", False), ("Can you attend our office 3 days per week?", "select", "q2", "logistical", True),
    ("Additional information", "textarea", "q3", "standard", False), ("What is your desired salary?", "text", "q4", "standard", False), ("Describe a product you shipped", "text", "q5", "substantive", False),
    ("Are you willing to relocate?", "select", "q6", "logistical", True), ("Anything", "text", "_systemfield_x", "standard", False),
]


@case(values([(i, a[3], a[4]) for i, a in enumerate(ASKED)], "pos, question_class, kept"))
def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02, FLT03: classes of questions and which are kept."""
    rows = spark.sql(f"SELECT * FROM {values([(i, *a[:3]) for i, a in enumerate(ASKED)], 'pos, label, kind, name')}")
    q = F.struct(F.col("label"), F.col("kind").alias("type"), F.array("name").alias("names"), F.array().cast("array<string>").alias("options"))
    return rows.withColumn("q", q).select("pos", questions.question_class("q").alias("question_class"), questions.kept("q").alias("kept"))


DISAGREE = [("San Francisco, CA; Remote, US", "Bay Area, CA", False, "USD 236,000–296,000", "$110,000 - $130,000", True), ("New York, NY", "Brooklyn, NY", False, "$150K", "", False), ("Austin, TX; New York, NY", "Denver, CO", True, "$200K - $300K", "$213,000 - $296,000", False), ("", "Denver, CO", False, "", "$90K", False)]


@case(values([(i, r[2], r[5]) for i, r in enumerate(DISAGREE)], "pos, places_differ, pay_differs"))
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET04, SET05: whether a field and the prose name other metros or other pay."""
    rows = spark.sql(f"SELECT * FROM {values([(i, r[0], r[1], r[3], r[4]) for i, r in enumerate(DISAGREE)], 'pos, a, b, c, d')}")
    return rows.select("pos", places.locations_disagree("a", "b").alias("places_differ"), pay.pay_disagrees("c", "d").alias("pay_differs"))


WRITTEN = [("“Hello”", "Hello", "careers at airbnb", "Airbnb", "PM - Careers at Acme", "PM"), (' "x" ', "x", "Acme Careers", "Acme", "Data Lead | Beta Jobs", "Data Lead"), ("plain", "plain", "Plain Co", "Plain Co", "Engineer - Platform", "Engineer - Platform")]


@case(values([(i, r[1], r[3], r[5]) for i, r in enumerate(WRITTEN)], "pos, bare, company, title"))
def name_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ05, FN16: quotes, wrappers of companies and branding of titles."""
    rows = spark.sql(f"SELECT * FROM {values([(i, r[0], r[2], r[4]) for i, r in enumerate(WRITTEN)], 'pos, q, c, t')}")
    return rows.select("pos", T.strip_wrapping_quotes("q").alias("bare"), identity.clean_company("c").alias("company"), identity.title_and_brand("t")["title"].alias("title"))
