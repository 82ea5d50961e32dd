"""The employer's own name by its page."""

from pyspark.sql import functions as F

from lodestack.operators import identity

PAGES = [
    *[(f"<title>{t}</title>", "Help Scout") for t in ("Senior PM – Careers at Help Scout", "Senior PM - Careers at Help Scout", "Senior PM — Jobs at Help Scout", "Senior PM | Help Scout Careers", "Careers at Help Scout")],
    ("<title>Senior PM – Careers at Acme Corporation</title>", "Acme Corporation"), ("<title>Senior Product Manager</title>", None), ("<title>Careers</title>", None), ("<body>none</body>", None), (None, None),
    ('<meta property="og:site_name" content="Help &amp; Co"><title>PM | Other Jobs</title>', "Help & Co"), ('<meta content="Help Scout" property="og:site_name">', "Help Scout"),
]


def test_pages(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, h string")
    assert [r[1] for r in rows.select("i", identity.declared_name("h")).orderBy("i").collect()] == [n for _, n in PAGES]
    assert rows.limit(1).select(identity.declared_name("h", F.lit("Own  Name"))).first()[0] == "Own Name"
