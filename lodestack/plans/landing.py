"""Settings, captures by name, batches and streams of files, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import locate, settings, tracker
from ..operators.order import new_folder
from ..sources import batches
from ..streaming import log as streams
from .log import EVENTS_SQL, PICKS, events
from .registry import literal, query, read

DEFAULTS = {"k": -1, "theme": "plain", "device": {"os": "any", "ver": "0", "screen": {"w": 800, "h": 600}}, "tags": ["x"]}
# null stays what a document says, so no key of the defaults is ever missing
# the clicks' own documents, and by id such as are cut off, no object, followed by more, deeper, or without an object
TOLD = """CASE click_id % 9 WHEN 0 THEN substring(props, 1, length(props) - 1) WHEN 1 THEN '[1, 2]' WHEN 2 THEN concat(props, ' x') WHEN 3 THEN concat('{"device": {"screen": {"w": ', click_id, '}, "ver": "9"}, "theme": "t', click_id % 4, '"}')
 WHEN 4 THEN concat('{"device": ', click_id, ', "k": ', click_id % 3 - 2, '}') WHEN 5 THEN '{"device": {"screen": "wide", "seen": {"by": [1, {"a": 2}]}}, "tags": []}' ELSE props END"""
PLACES = {"k": "$.k", "theme": "$.theme", "os": "$.device.os", "ver": "$.device.ver", "w": "$.device.screen.w", "h": "$.device.screen.h", "by": "$.device.seen.by[1].a"}


@query(f"""
WITH t AS (SELECT click_id, {TOLD} AS t FROM clicks),
m AS (SELECT click_id, json_merge_patch({literal('{"k": -1, "theme": "plain", "device": {"os": "any", "ver": "0", "screen": {"w": 800, "h": 600}}, "tags": ["x"]}')}::JSON, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t ELSE '{{}}' END ELSE '{{}}' END::JSON) AS m FROM t)
SELECT click_id, {", ".join(f"m ->> '{p}' AS {n}" for n, p in PLACES.items())}, array_to_string(list_sort(list_distinct(list_concat(json_keys(m), ['tags']))), ' ') AS keys, coalesce(json_array_length(m -> '$.tags'), -1)::INT AS n_tags,
  CASE WHEN m ->> '$.device.screen.w' IS DISTINCT FROM '800' THEN 'device.screen.w ' ELSE '' END || CASE WHEN m ->> '$.theme' IS DISTINCT FROM 'plain' THEN 'theme' ELSE '' END AS overridden FROM m
""")
def settings_over_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC26, SRC19: every click's document over defaults three objects deep; unreadable ones give the defaults."""
    t = read(spark, sf_dir, "clicks").select("click_id", F.expr(TOLD).alias("t"))
    m = t.select("click_id", settings.over_defaults(F.col("t"), DEFAULTS).alias("m"), settings.overrides(F.col("t"), DEFAULTS).alias("o"))
    said = [F.try_variant_get("m", p, "string").alias(n) for n, p in PLACES.items()]
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get("m", "$", settings.OBJECT))), " ")
    differs = lambda p, end="": F.when(F.array_contains("o", p), F.lit(p + end)).otherwise("")
    return m.select("click_id", *said, keys.alias("keys"), F.coalesce(F.size(F.try_variant_get("m", "$.tags", "array<variant>")), F.lit(-1)).alias("n_tags"), F.concat(differs("device.screen.w", " "), differs("theme")).alias("overridden"))


# a file an order at one of seven places of its customer's batch, the last in no place where its row looks
FILE = """CASE o_orderkey % 7 WHEN 0 THEN concat('loose/', o_orderkey, '.txt') WHEN 1 THEN concat('reviews/b', o_custkey, '/rank/', o_orderkey % 1000, '.txt') WHEN 2 THEN concat('reviews/b', o_custkey, '/', o_orderkey % 1000, '.txt')
 WHEN 3 THEN concat('reviews/b', o_custkey, '/sources/captures/', o_orderkey % 1000, '.txt') WHEN 4 THEN concat('reviews/b', o_custkey, '/rank/', o_orderpriority, '/x', o_orderkey % 3, '/', o_orderkey % 1000, '.txt')
 WHEN 5 THEN concat('reviews/b', o_custkey, '/other/', o_orderkey % 1000, '.txt') ELSE concat('reviews/b', o_custkey, 'x/rank/', o_orderkey % 1000, '.txt') END"""
NAME = "CASE WHEN o_orderkey % 7 = 0 THEN concat('loose/', o_orderkey, '.txt') ELSE concat(CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'old/' END, o_orderkey % 1000, '.txt') END"


@query(f"""
WITH f AS (SELECT DISTINCT {FILE} AS path FROM orders), l AS (SELECT path, regexp_extract(path, '[^/]+$') AS last, len(string_split(path, '/')) AS depth FROM f),
r AS (SELECT o_orderkey, {NAME} AS name, 'reviews/b' || o_custkey AS above, regexp_extract({NAME}, '[^/]+$') AS last FROM orders),
c AS (SELECT o_orderkey, path, depth, CASE WHEN path = name THEN 0 WHEN path = above || '/rank/' || name THEN 1 WHEN path = above || '/' || name THEN 2 WHEN path = above || '/sources/captures/' || r.last THEN 3
  WHEN starts_with(path, above || '/rank/') THEN 4 WHEN starts_with(path, above || '/') AND above IN (SELECT regexp_extract(path, '^(.*)/sources/', 1) FROM f) THEN 5 END AS rank FROM r JOIN l ON r.last = l.last)
SELECT o_orderkey, arg_min(path, (rank, depth, path)) AS path, min(rank)::INT AS rank FROM c WHERE rank IS NOT NULL GROUP BY o_orderkey
""")
def located_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC28: the file of each order's row: as given, in three fixed places, or by a search within its own batch."""
    o = read(spark, sf_dir, "orders")
    rows = o.selectExpr("o_orderkey", f"{NAME} AS name", "concat('reviews/b', o_custkey, '/rank') AS base")
    return locate.locate(rows, o.selectExpr(f"{FILE} AS path"), "o_orderkey")


@query(f"WITH e AS ({EVENTS_SQL}) SELECT key, {PICKS.format(o='seq', l='(fetched_at, seq)')} FROM e GROUP BY key")
def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01: the log's states kept by a stream that is started twice and takes files in micro-batches, out of order."""
    folder = new_folder(spark, "registry")
    e = events(spark, sf_dir)
    for half in range(2):
        e.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == half).write.mode("append").parquet(f"{folder}/events")
        streams.advance(spark, f"{folder}/events", e.schema, folder, files=4)
    return streams.current(spark, folder)


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS old, CASE WHEN o_orderstatus = 'F' THEN upper(trim(substring(o_orderpriority, 3))) ELSE o_orderpriority END AS new FROM orders)
SELECT o_orderstatus, count(*) AS n_rows, sum((old <> new)::INT)::BIGINT AS n_changed, count(DISTINCT new) AS n_values, 0::BIGINT AS changed_again FROM o GROUP BY o_orderstatus
""")
def rewritten_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: all orders as a table by status, whose finished ones' priorities lose their number; a second run changes
    no cell and no file."""
    path = new_folder(spark, "orders")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o.write.partitionBy("o_orderstatus").parquet(path)
    own = F.col("o_orderpriority")
    fixes = {"o_orderpriority": F.when(F.col("o_orderstatus") == "F", F.upper(F.trim(F.regexp_replace(own, "^[0-9]-", "")))).otherwise(own)}
    tracker.rewrite_changed(spark, path, "o_orderstatus", fixes)
    again = tracker.rewrite_changed(spark, path, "o_orderstatus", fixes)
    now = spark.read.parquet(path)
    changed = (~F.col("o_orderpriority").rlike("^[0-9]-")).cast("long")
    return now.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum(changed).alias("n_changed"), F.count_distinct("o_orderpriority").alias("n_values")).withColumn("changed_again", F.lit(again).cast("long"))


@query("""
SELECT CASE WHEN doc_id % 3 = 0 THEN '01-05-24' WHEN doc_id % 3 = 1 THEN '01-06-24' ELSE '01-07-24-b' END AS batch, CASE WHEN text IS NULL OR text = '' THEN 'failed' WHEN length(text) < 200 THEN 'thin' ELSE 'usable' END AS status,
  count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS n_chars, count(*) AS told FROM documents GROUP BY ALL
""")
def published_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03: all documents written as three batches and read back, beside tries that stopped half way,
    with the counts that manifests tell."""
    root = new_folder(spark, "batches")
    status = F.when(F.coalesce("text", F.lit("")) == "", "failed").when(F.length("text") < 200, "thin").otherwise("usable")
    d = read(spark, sf_dir, "documents").select("doc_id", "text", status.alias("status"))
    for n, name in enumerate(["01-05-24", "01-06-24", "01-07-24-b"]):
        own = d.where(F.col("doc_id") % 3 == n)
        batches.stage(own, root, name, "lost")
        batches.publish(own, root, name, "whole")
    seen = batches.published(spark, root).groupBy("batch", "status").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    told = batches.manifests(spark, root).select(F.col("batch").alias("_b"), F.col("status").alias("_s"), F.col("n").alias("told"))
    return seen.join(told, (F.col("batch") == F.col("_b")) & (F.col("status") == F.col("_s"))).drop("_b", "_s")
