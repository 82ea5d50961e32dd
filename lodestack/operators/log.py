"""The capture log: append-only events, a state a posting, replay, shard merges and aliases.

An event has key, fetched_at (timestamp), url, ok and seq (its arrival). The state keeps an original, set once by the
first success to arrive, and a latest, which a success replaces if it is as new or newer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(events: DataFrame) -> DataFrame:
    """(key, n_events, n_ok, original_*, latest_*) after all events in order of arrival.

    The latest is the success with the greatest fetched_at, the last to arrive among equals; both picks are
    combinable maxima, so a hot key costs a row a task."""
    good = F.col("ok")
    event = F.struct("fetched_at", "url")
    first = F.min_by(event, F.when(good, F.col("seq")))
    latest = F.max_by(event, F.when(good, F.struct("fetched_at", "seq")))
    out = events.groupBy("key").agg(F.count("*").alias("n_events"), F.sum(good.cast("long")).alias("n_ok"), first.alias("o"), latest.alias("l"))
    return out.select("key", "n_events", "n_ok", F.col("o.fetched_at").alias("original_at"), F.col("o.url").alias("original_url"), F.col("l.fetched_at").alias("latest_at"), F.col("l.url").alias("latest_url"))


def replay(events: DataFrame) -> DataFrame:
    """The state after a chronological replay: repeated (key, fetched_at, url) count once, whatever arrived when.

    Of repeats the first to arrive stays; the original is then the earliest success."""
    once = events.groupBy("key", "fetched_at", "url").agg(F.min_by("ok", "seq").alias("ok"))
    ordered = once.withColumn("seq", F.struct("fetched_at", "url"))
    good = F.col("ok")
    event = F.struct("fetched_at", "url")
    out = ordered.groupBy("key").agg(F.count("*").alias("n_events"), F.sum(good.cast("long")).alias("n_ok"), F.min_by(event, F.when(good, F.col("seq"))).alias("o"), F.max_by(event, F.when(good, F.col("seq"))).alias("l"))
    return out.select("key", "n_events", "n_ok", F.col("o.fetched_at").alias("original_at"), F.col("o.url").alias("original_url"), F.col("l.fetched_at").alias("latest_at"), F.col("l.url").alias("latest_url"))


def merge_shards(log: DataFrame, shards: DataFrame, accepted: DataFrame) -> DataFrame:
    """log and the accepted keys' events of shards; of repeated (key, fetched_at, url) the log's row stays."""
    new = shards.join(accepted.select("key").distinct(), "key", "left_semi")
    both = log.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    others = [c for c in log.columns if c not in ("key", "fetched_at", "url")]
    picked = both.groupBy("key", "fetched_at", "url").agg(F.min_by(F.struct(*others), F.struct("_s", "seq")).alias("r"))
    return picked.select("key", "fetched_at", "url", *[F.col(f"r.{c}").alias(c) for c in others])


def resolve_aliases(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """keys with resolved: the key itself where it is a posting, else the posting whose aliases hold it, else itself."""
    own = postings.select(F.col("key").alias("_own")).distinct()
    alias = postings.select(F.explode("aliases").alias("_a"), F.col("key").alias("_to")).groupBy("_a").agg(F.min("_to").alias("_to"))
    joined = keys.join(own, F.col("key") == F.col("_own"), "left").join(alias, F.col("key") == F.col("_a"), "left")
    return joined.withColumn("resolved", F.coalesce("_own", "_to", "key")).drop("_own", "_a", "_to")


def merge_postings(states: DataFrame) -> DataFrame:
    """States that stand under one key as one: earliest original, latest success (the first of equals), all aliases."""
    event = lambda n: F.struct(F.col(f"{n}_at").alias("at"), F.col(f"{n}_url").alias("url"))
    out = states.groupBy("key").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_ok").alias("n_ok"), F.min_by(event("original"), F.struct("original_at", "pos")).alias("o"),
        F.max_by(event("latest"), F.struct("latest_at", (-F.col("pos")).alias("p"))).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )
    return out.select("key", "n_events", "n_ok", F.col("o.at").alias("original_at"), F.col("o.url").alias("original_url"), F.col("l.at").alias("latest_at"), F.col("l.url").alias("latest_url"), "aliases")


def canonical_keys(events: DataFrame, own_key) -> DataFrame:
    """(key, canonical, conflict): the one identity that a posting's own events show; several are a conflict and leave
    the key as it is."""
    shown = events.select("key", own_key.alias("_i")).groupBy("key").agg(F.count_distinct("_i").alias("n"), F.min("_i").alias("i"))
    return shown.select("key", F.when(F.col("n") == 1, F.col("i")).otherwise(F.col("key")).alias("canonical"), (F.col("n") > 1).alias("conflict"))
