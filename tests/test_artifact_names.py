"""File names of artifacts in the one spelling."""

from pyspark.sql import functions as F

from lodestack.functions import names

PEOPLE = [("Jordan Lee", "Jordan Lee-Resume"), ("Jean-Luc Picard", "Jean-Luc Picard-Resume"), ("Cher", "Cher-Resume"), ("  Jordan   Lee  ", "Jordan Lee-Resume"), ("Jordan/Lee", "Jordan Lee-Resume"), ("", "Resume"), (None, "Resume")]
REPAIRED = [
    ("Jordan-Lee-CoverLetter - Acme - Senior PM, Growth.docx", "Jordan Lee-Cover-Letter - Acme - Senior PM, Growth.docx"), ("Jordan_cv - Acme - PM.pdf", "Jordan_-Resume - Acme - PM.pdf".replace("_-", "-")),
    ("Cover-Letter-Draft - Acme - PM.docx", "Cover-Letter-Draft - Acme - PM.docx"), ("notes.txt", "notes.txt"), ("Jordan Lee-Resume - Acme - PM.pages", "Jordan Lee-Resume - Acme - PM.pages"),
]


def test_people(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PEOPLE)], "i int, p string")
    got = rows.select("i", names.artifact_name("p", F.lit("Acme"), F.lit("Sr PM, Growth"), ".docx")).orderBy("i").collect()
    assert [r[1] for r in got] == [f"{stem} - Acme - Senior PM, Growth.docx" for _, stem in PEOPLE]


def test_endings(spark):
    row = spark.range(1).select(*[names.artifact_name(F.lit("Jordan Lee"), F.lit("A/B: C "), F.lit("PM"), e, "Cover-Letter").alias(str(i)) for i, e in enumerate((".pages", "pdf", ""))]).first()
    assert list(row) == ["Jordan Lee-Cover-Letter - A B C - PM.pages", "Jordan Lee-Cover-Letter - A B C - PM.pdf", "Jordan Lee-Cover-Letter - A B C - PM"]


def test_repair(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(REPAIRED)], "i int, f string")
    assert [r[1] for r in rows.select("i", names.repaired_artifact("f")).orderBy("i").collect()] == [b for _, b in REPAIRED]
