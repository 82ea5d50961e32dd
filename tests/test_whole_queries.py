"""Queries over whole tables leave no row out."""

import os

import pyarrow.parquet as pq
import pytest

from lodestack.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def test_all_rows_take_part(spark):
    got = lambda name: registry.QUERIES[name](spark, DATA).collect()
    parts, customers, orders, items = (table(n) for n in ("part", "customer", "orders", "lineitem"))
    words = {p["p_partkey"]: set(p["p_name"].split()) for p in parts}
    pairs = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 2}
    assert {(r["p_partkey"], r["other"]) for r in got("token_overlap_join")} == pairs
    c = [(x["c_custkey"], x["c_nationkey"], x["c_mktsegment"]) for x in customers]
    assert sorted((r["c_custkey"], r["other"]) for r in got("disjunctive_match")) == sorted((a[0], b[0]) for a in c for b in c if a[0] < b[0] and (a[1] == b[1] or a[2] == b[2]))
    assert {r["grp"] for r in got("duplicate_control")} == {x["l_suppkey"] for x in items}
    assert {r["url"] for r in got("first_boards")} == {x["l_orderkey"] for x in items if x["l_linenumber"] in (2, 4)} & {o["o_orderkey"] for o in orders}
    assert sum(r["n"] for r in got("grouped_report")) == len(orders)
    kinds = {}
    for o in orders:
        kinds.setdefault(o["o_custkey"], set()).add(o["o_orderstatus"])
    assert {r["o_custkey"]: r["formats"] for r in got("duplicate_artifacts")} == {k: len(v) for k, v in kinds.items() if len(v) > 1}
