"""Joins on hubs: the same rows as a plain join, in tasks of bounded size; large buckets on the last level."""

from pyspark.sql import functions as F

from lodestack.llm import components, ngramjoin
from lodestack.llm.common import Workspace


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 20)
    rows = spark.range(600).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = spark.range(700).select(F.col("id").alias("own"), (F.col("id") * 2).alias("twice"))
    got = components.spread_join(rows, table, "k", "own", 600)
    assert sorted((r["k"], r["v"], r["twice"]) for r in got.collect()) == sorted((7 if i < 400 else i, i, 14 if i < 400 else 2 * i) for i in range(600))


def test_a_hub_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5)
    edges = [(i, 1000) for i in range(1, 200)] + [(1000, 0)] + [(3000 + i, 3001 + i) for i in range(40)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "hub"), "hub")
    got = {r["node"]: r["label"] for r in found.collect()}
    assert all(got[i] == 0 for i in [*range(200), 1000]) and all(got[3000 + i] == 3000 for i in range(41))


def test_large_buckets_on_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "SMALL", 4)
    monkeypatch.setattr(ngramjoin, "DEPTH", 1)
    base = [f"w{i}" for i in range(60)]
    rows = [(g * 100 + i, " ".join([f"g{g}", *base[: 40 + g], f"e{g}x{i}"])) for g in range(3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.join(docs).collect()}
    from test_brute import brute_join

    assert got == {d: (c, n) for d, c, n in brute_join(rows)}
