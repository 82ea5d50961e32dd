"""Checks of written texts over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import writing
from .matching import SENTENCES
from .registry import case, query, read, values


@query(f"""
WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(s, '[^ ]+')) AS n FROM s)
SELECT doc_id, count(*)::BIGINT AS n_sentences, round(stddev_pop(n) / avg(n), 6) AS variation FROM n GROUP BY doc_id HAVING count(*) >= 8
""")
def letter_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08: how much the lengths of a document's sentences vary, from eight on."""
    return writing.rhythm(read(spark, sf_dir, "documents"), "doc_id").withColumn("variation", F.round("variation", 6))


PHRASES = [("licensed under", "license"), ("copyright", "license"), ("example.com", "address"), (" the the ", "stutter")]


@query(f"""
WITH r AS (SELECT * FROM {values(PHRASES, 'phrase, rule')})
SELECT doc_id, rule, phrase, ((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase))::BIGINT AS n FROM documents, r WHERE contains(lower(text), phrase)
""")
def lint_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34: phrases that rules forbid, by document."""
    rules = spark.sql(f"SELECT * FROM {values(PHRASES, 'phrase, rule')}")
    return writing.phrase_hits(read(spark, sf_dir, "documents"), rules, "doc_id")


BULLETS = [("- **Led** the [team](https://x.y) to a launch, with care and speed in mind", "led the team to a launch with care and speed in mind", True), ("* short one", "short one", False)]


@case(values([(i, b[1], b[2]) for i, b in enumerate(BULLETS)], "pos, k, counts"))
def bullet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN37: what copies of a bullet share, and whether it is long enough to count."""
    rows = spark.sql(f"SELECT * FROM {values([(i, b[0]) for i, b in enumerate(BULLETS)], 'pos, b')}").withColumn("k", T.bullet_key("b"))
    return rows.select("pos", "k", (F.size(F.split("k", " ")) >= 8).alias("counts"))


@query("""
WITH t AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'dear ') THEN 'letter' WHEN len(regexp_extract_all(t, '[?]')) >= 2 THEN 'questions' ELSE 'other' END AS kind FROM t
""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN36: what kind of page a text is."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", writing.page_kind("text").alias("kind"))
