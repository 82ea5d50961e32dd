"""Bootstrapping: instances found by one pattern induce another, on either side; long texts stay cheap."""

import time

from lodestack.llm import pii


def test_instances_induce_patterns(spark):
    seeds = [f"please call me at +1 (555) 010-{1000 + i} soon" for i in range(9)]
    # loose numbers at the sure pattern, which also stand before a word that no seed has
    bridge = [f"so call me at 555-010-{2000 + i} kindly" for i in range(9)]
    far = ["reach us 555-010-3000 kindly", "serial 555-010-4000 broken"]
    texts = seeds + bridge + far
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all(got[i].startswith("phone:18:") or got[i].startswith("phone:14:") for i in range(18))
    assert got[18] == "phone:9:21" and got[19] == ""
    assert {r["doc_id"]: r["spans"] for r in pii.find(docs, rounds=1).collect()}[18] == ""


def test_words_on_both_sides():
    text = "write to Jane at 12-34 Now, or"
    assert pii.before(text, 17) == ["at", "jane at"] and pii.behind(text, 22) == ["> now"]
    assert pii.behind("12-34", 5) == [] and pii.before("12-34", 0) == []


def test_long_texts_of_numbers_are_linear():
    text = " ".join(f"a{i}@b.org 10.0.{i % 256}.1 tel {i}" for i in range(20_000))
    began = time.process_time()
    assert len(pii.tokens(text, pii.base(text))) >= 40_000
    assert time.process_time() - began < 20
