"""The capture log over the events table: a user is a posting, a purchase-like event a success."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log
from .registry import case, query, read, values


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("url"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq"))


EVENTS_SQL = "SELECT user_id AS key, ts AS fetched_at, 'e' || event_id AS url, event_type <> 'error' AS ok, event_id AS seq FROM events"
PICKS = """count(*)::BIGINT AS n_events, sum(ok::INT)::BIGINT AS n_ok,
       arg_min(fetched_at, {o}) FILTER (ok) AS original_at, arg_min(url, {o}) FILTER (ok) AS original_url,
       arg_max(fetched_at, {l}) FILTER (ok) AS latest_at, arg_max(url, {l}) FILTER (ok) AS latest_url"""


@query(f"WITH e AS ({EVENTS_SQL}) SELECT key, {PICKS.format(o='seq', l='(fetched_at, seq)')} FROM e GROUP BY key")
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01: originals and latests by arrival."""
    return log.state(events(spark, sf_dir))


@query(f"""
WITH e AS ({EVENTS_SQL}), once AS (SELECT key, fetched_at, url, arg_min(ok, seq) AS ok FROM e GROUP BY ALL)
SELECT key, {PICKS.format(o='(fetched_at, url)', l='(fetched_at, url)')} FROM once GROUP BY key
""")
def registry_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02, SET02: a log that stands twice replays as one."""
    e = events(spark, sf_dir)
    return log.replay(e.unionByName(e))


@query(f"""
WITH e AS ({EVENTS_SQL}), old AS (SELECT * FROM e WHERE seq % 3 <> 0), new AS (SELECT * FROM e WHERE seq % 2 = 0 AND key % 2 = 0)
SELECT key, fetched_at, url, ok, seq FROM old
UNION ALL SELECT key, fetched_at, url, ok, seq FROM new WHERE seq NOT IN (SELECT seq FROM old)
""")
def registry_shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET02: a shard's events of accepted keys join the log once."""
    e = events(spark, sf_dir)
    return log.merge_shards(e.where("seq % 3 <> 0"), e.where("seq % 2 = 0"), e.where("key % 2 = 0"))


@query(f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT key % 100 AS key, key AS pos, {PICKS.format(o='seq', l='(fetched_at, seq)')} FROM e GROUP BY e.key)
SELECT key, sum(n_events)::BIGINT AS n_events, sum(n_ok)::BIGINT AS n_ok,
       arg_min(original_at, (original_at, pos)) FILTER (original_at IS NOT NULL) AS original_at, arg_min(original_url, (original_at, pos)) FILTER (original_at IS NOT NULL) AS original_url,
       arg_max(latest_at, (latest_at, -pos)) FILTER (latest_at IS NOT NULL) AS latest_at, arg_max(latest_url, (latest_at, -pos)) FILTER (latest_at IS NOT NULL) AS latest_url,
       array_to_string(list_sort(list_distinct(list('u' || pos))), ' ') AS aliases
FROM s GROUP BY key
""")
def posting_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET03: states of users that share their last two digits as one posting."""
    s = log.state(events(spark, sf_dir)).withColumn("pos", F.col("key")).withColumn("key", F.col("key") % 100)
    s = s.withColumn("aliases", F.array(F.concat(F.lit("u"), F.col("pos").cast("string"))))
    return log.merge_postings(s).withColumn("aliases", F.array_join("aliases", " "))


@query("SELECT c.c_custkey AS key, coalesce(p.c_custkey, c.c_custkey) AS resolved FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey - c.c_custkey % 3")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN07: customers whose number is no multiple of three are aliases of the one before that is."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    postings = c.where("key % 3 = 0").withColumn("aliases", F.array(F.col("key") + 1, F.col("key") + 2))
    return log.resolve_aliases(c, postings).select("key", "resolved")


@query("""
SELECT o_custkey AS key, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE o_custkey::VARCHAR END AS canonical, count(DISTINCT o_orderstatus) > 1 AS conflict
FROM orders GROUP BY o_custkey
""")
def canonical_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR03: a posting is renamed to the one identity that its events show, and left alone if they show several."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("n"), F.col("o_custkey").cast("string").alias("key"), "o_orderstatus")
    return log.canonical_keys(o, F.col("o_orderstatus")).select(F.col("key").cast("long").alias("key"), "canonical", "conflict")


@case(values([("a", "pay: 100 in NYC", True, "2026-01-02"), ("b", "duties, pay: 5", False, "2026-03-01")], "k, body, kept_old_body, posted_date"))
def best_verified_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR05: a body that lost its pay doesn't replace one that has it; lost dates stay."""
    from ..operators.captures import best_verified

    old = spark.sql(f"SELECT k, body, posted_date, CAST(NULL AS STRING) updated_date FROM {values([('a', 'pay: 100 in NYC', '2026-01-02'), ('b', 'duties', '2026-01-03')], 'k, body, posted_date')}")
    new = spark.sql(f"SELECT k, body, posted_date, CAST(NULL AS STRING) updated_date FROM {values([('a', 'short text', None), ('b', 'duties, pay: 5', '2026-03-01')], 'k, body, posted_date')}")
    return best_verified(new, old, "k", {"pay": ["pay:"], "duties": ["duties"]}).select("k", "body", "kept_old_body", "posted_date")
