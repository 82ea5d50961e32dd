"""Phrases that letters shouldn't have."""

from lodestack.operators.writing import phrase_hits


def test_no_rules_and_odd_ones(spark):
    texts = spark.createDataFrame([(1, "A leverage and LEVERAGE"), (2, None), (3, "")], "k long, text string")
    rules = spark.createDataFrame([("leverage", "cliche"), ("", "empty"), (None, "null")], "phrase string, rule string")
    assert [tuple(r) for r in phrase_hits(texts, rules, "k").collect()] == [(1, "cliche", "leverage", 2)]
    assert phrase_hits(texts, rules.where("rule = 'empty'"), "k").collect() == []
    assert phrase_hits(texts, rules.limit(0), "k").columns == ["k", "rule", "phrase", "n"]
