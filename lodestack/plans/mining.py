"""Miners and lint over authored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters, miners
from .registry import case, values

PAY = [
    ("The salary range for this role is $197,300.", "$197,300"), ("raised $50,000,000", ""), ("Base pay: 150,000 - 180,000 annually. NYC: $170K–$200K", "150,000 - 180,000 | $170K–$200K"),
    ("between 2000 to 3000 people", ""), ("OTE salary of $300,000 total compensation", ""), ("", ""), ("Pay $100K - $120K. Pay $100K - $120K.", "$100K - $120K"),
]


@case(values([(i, b) for i, (_, b) in enumerate(PAY)], "pos, figures"))
def prose_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12: pay in prose."""
    rows = spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(PAY)], 'pos, t')}")
    return rows.select("pos", F.array_join(F.transform(miners.prose_pay("t"), lambda f: f["value"]), " | ").alias("figures"))


PLACES = [
    ("Location: Google Cloud\nAustin, TX", "Austin, TX"), ("We have offices in New York, NY and San Francisco, CA.", "New York, NY; San Francisco, CA"), ("This is a fully remote team", "Fully Remote"),
    ("Three days, hybrid", "hybrid"), ("Locations", None), ("Location: Menu", None), ("", None), ("Work Location: London, UK", "London, UK"), ("near Springfield, ZZ", None),
]
PLACES = [(a.replace("Location: Google Cloud\nAustin, TX", "Location: Austin, TX (Google Cloud)"), b) for a, b in PLACES]


@case(values([(i, b) for i, (_, b) in enumerate(PLACES)], "pos, place"))
def prose_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13, FLT11, SRT05: places in prose."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(PLACES)], 'pos, t')}").select("pos", miners.prose_location("t").alias("place"))


WORKED = [
    ("FullTime", "a full time, exempt role", "Full Time, Exempt", "three days per week: Tuesday, Wednesday, Thursday", "3 Days Per Week, Tuesday–Thursday"), ("", "This is a part-time position", "Part Time", "at least 2 days per week", "At Least 2 Days Per Week"),
    ("", "we work full-time on fun", "Not Specified", "flexible", "flexible"), ("INTERN", "", "INTERN", "1 day per week", "1 Day Per Week"), ("", "Full time, non-exempt", "Full Time, Non-Exempt", "two days a week, Monday and Friday", "2 Days Per Week, Monday, Friday"),
]


@case(values([(i, w[2], w[4]) for i, w in enumerate(WORKED)], "pos, employment, cadence"))
def employment_and_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN20, FN21: employment types and cadences in readable form."""
    rows = spark.sql(f"SELECT * FROM {values([(i, w[0], w[1], w[3]) for i, w in enumerate(WORKED)], 'pos, s, b, c')}")
    return rows.select("pos", miners.employment("s", "b").alias("employment"), miners.format_cadence("c").alias("cadence"))


CAPTURED = [
    ("a", True, "PM", "$150K - $180K", "NYC", "", "found", "found"), ("b", True, "PM", "", "", "nothing here", "not_posted", "not_posted"), ("c", False, "PM", "", "", "nothing here", "capture_failed", "capture_failed"),
    ("d", True, "PM", "USD 236,000–296,000", "Austin, TX", "salary $110,000 - $130,000 in Denver, CO", "conflicting", "conflicting"), ("e", False, "PM", "", "", "salary is $197,300 in Denver, CO", "found", "found"),
    ("f", True, "PM", "", "", "total compensation of $300,000", "found", "not_posted"),
]


@case(values([(r[0], r[6], r[7]) for r in CAPTURED], "k, pay, place"))
def capture_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT05: whether pay and place of captures are found, not posted, failed or conflicting."""
    rows = spark.sql(f"SELECT * FROM {values([r[:6] for r in CAPTURED], 'k, structured, title, pay, place, body')}").withColumn("figures", miners.prose_pay("body"))
    none, no = F.lit(None).cast("array<struct<label:string,type:string,names:array<string>,options:array<string>>>"), F.lit(False)
    s = miners.completeness(F.lit("x"), "structured", "title", "pay", "place", "body", "figures", none, no, no)
    return rows.select("k", s["compensation"].alias("pay"), s["working_location"].alias("place"))


NAMES = [("greenhouse-boards-api", "Greenhouse"), ("workday-cxs-api (embedded)", "Workday (Embedded)"), ("", "Employer Page"), ("linkedin-guest-api", "linkedin-guest-api"), ("linkedin-guest", "LinkedIn (Guest)")]


@case(values([(i, b) for i, (_, b) in enumerate(NAMES)], "pos, shown"))
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24: sources by the names that people know."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(NAMES)], 'pos, t')}").select("pos", miners.source_name("t").alias("shown"))


LETTERS = [
    ("I do not know; it is — fine.", "error:em-dash,error:semicolon,error:contraction,error:links,warn:energy,warn:length", None), ("See [here](https://a.b)! " + "word " * 300, "error:link-anchor", None),
    ("Text with [a quiet link](https://a.b)! " + "word " * 250, "error:smoothing,error:smoothing-links", "Text with [a link](https://c.d)! Fun! " + "word " * 250),
]


@case(values([(i, b) for i, (_, b, _) in enumerate(LETTERS)], "pos, findings"))
def letter_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34, SET06: what letters break, and what their revision lost."""
    rows = spark.sql(f"SELECT * FROM {values([(i, a, c) for i, (a, _, c) in enumerate(LETTERS)], 'pos, t, old')}")
    kept = F.when(F.col("old").isNull(), letters.findings("t")).otherwise(letters.findings("t", "old"))
    return rows.select("pos", F.array_join(kept, ",").alias("findings"))
