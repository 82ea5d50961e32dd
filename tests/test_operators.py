"""Operators where order, ties, repeats and nulls decide."""

import itertools

from pyspark.sql import functions as F

from lodestack.operators import captures, log, matching, review, tracker


def test_state_by_arrival_and_replay_by_time(spark):
    events = [("k", 2, "a", False, 0), ("k", 3, "b", True, 1), ("k", 1, "c", True, 2), ("k", 3, "d", True, 3), ("z", 1, "e", False, 4)]
    frame = spark.createDataFrame(events, "key string, t long, url string, ok boolean, seq long").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")
    s = {r["key"]: r for r in log.state(frame).collect()}
    assert (s["k"]["original_url"], s["k"]["latest_url"], s["k"]["n_events"], s["k"]["n_ok"]) == ("b", "d", 4, 3)
    assert s["z"]["original_url"] is None and s["z"]["n_ok"] == 0
    first = log.replay(frame).orderBy("key").collect()
    assert first == log.replay(frame.unionByName(frame)).orderBy("key").collect()
    shuffled = frame.withColumn("seq", 10 - F.col("seq"))
    assert first == log.replay(shuffled).orderBy("key").collect()
    assert first[0]["original_url"] == "c"


def test_merge_keeps_the_log_on_ties(spark):
    cols = "key string, fetched_at long, url string, ok boolean, seq long"
    old, new = spark.createDataFrame([("a", 1, "u", True, 1)], cols), spark.createDataFrame([("a", 1, "u", False, 2), ("a", 2, "u", True, 3), ("b", 1, "u", True, 4)], cols)
    got = log.merge_shards(old, new, spark.createDataFrame([("a",)], "key string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "u", True, 1), ("a", 2, "u", True, 3)]


def test_attempts_against_a_plain_fold(spark):
    kinds = [("usable", 0), ("usable", 1), ("thin", 0), ("thin", 2), ("failed", 2)]
    rank = {"usable": 2, "thin": 1, "failed": 0}
    rows, expected = [], {}
    for n, tries in enumerate(itertools.product(kinds, repeat=3)):
        rows += [(n, i, s, m) for i, (s, m) in enumerate(tries)]
        won = 0
        for i in (1, 2):
            (s, m), (t, k) = tries[i], tries[won]
            if rank[s] > rank[t] or (s == "usable" and m < k):
                won = i
        expected[n] = won
    got = captures.fold_attempts(spark.createDataFrame(rows, "k int, attempt int, status string, missing int"), "k")
    assert {r["k"]: r["attempt"] for r in got.collect()} == expected


def test_first_wins_with_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "pos int, k string")
    got = captures.first_wins(rows, "k", "pos", "pos").orderBy("pos").collect()
    assert [r["is_duplicate"] for r in got] == [False, True, False, True, False]
    assert [r["duplicate_of"] for r in got] == [None, 1, None, 3, None]


def test_containment_direction(spark):
    rows = spark.createDataFrame([(1, "Acme Health, Inc."), (2, "Acme"), (3, None), (4, "")], "pos int, company string")
    names = spark.createDataFrame([("acme health",), ("",), (None,)], "name string")
    assert [r["pos"] for r in matching.contained(rows, names, "company").collect()] == [1]


def test_containment_inside_words(spark):
    rows = spark.createDataFrame([(1, "Big Acme Health"), (2, "Acme"), (3, "xacme health")], "pos int, company string")
    names = spark.createDataFrame([("acme health",)], "name string")
    assert sorted(r["pos"] for r in matching.contained(rows, names, "company").collect()) == [1, 3]


def test_on_ice_ties_keep_the_first(spark):
    rows = spark.createDataFrame([(1, "A", "80"), (2, "A", "80"), (3, "A", "x"), (4, "B", "10"), (5, "C", "90")], "pos int, company string, score string")
    applied = spark.createDataFrame([("C",)], "name string")
    got = matching.one_open_per_company(rows, "company", "score", "pos", applied).orderBy("pos").collect()
    assert [r["on_ice"] for r in got] == [False, True, True, False, True]


def test_migration_is_idempotent(spark):
    old = spark.createDataFrame([("j", "x", "2026-01-01", "", "e")], "`Job File` string, Old string, `ATS First Posted Date` string, `ATS Last Updated Date` string, Extra string")
    once = tracker.migrate(old, ["Company", "Job File", "Posting Last Update"], {"Old": "Company"}, [])
    assert once.columns == ["Company", "Job File", "Posting Last Update", "Extra"]
    twice = tracker.migrate(once, ["Company", "Job File", "Posting Last Update"], {"Old": "Company"}, [])
    assert once.collect() == twice.collect() and tuple(once.first()) == ("x", "j", "2026-01-01", "e")


def test_normalize_changes_nothing_twice(spark):
    rows = spark.createDataFrame([("apply asap high prio", "Work Tools", "New York hybrid", "$120K-$150K", "")], "`Status? [You Change]` string, Lane string, `Working Location` string, `Comp Range` string, `Posting Last Update` string")
    once = tracker.normalize(rows)
    assert once.first()["repaired"] == 5
    assert tracker.normalize(once.drop("repaired")).first()["repaired"] == 0


def test_updates_make_columns_and_keep_nulls(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, x string")
    u = spark.createDataFrame([("a", None, "n")], "k string, x string, y string")
    assert sorted(map(tuple, tracker.update_rows(rows, u, "k").select("k", "x", "y").collect())) == [("a", "1", "n"), ("b", "2", "")]


def test_append_once_and_provenance(spark):
    a = spark.createDataFrame([("a", 1)], "k string, score int")
    b = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, score int")
    once = review.append_once(a, b, "k")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3)]
    assert once.count() == review.append_once(once, b, "k").count()
    assert sorted(map(tuple, review.provenance(a, b.dropDuplicates(), "k").collect())) == [("a", 2, 1), ("b", 3, None)]


def test_quality_gate(spark):
    none = spark.createDataFrame([], "key string, failure string")
    assert tuple(review.quality_gate(none, none).first()) == (True, 0)
    assert tuple(review.quality_gate(none, spark.createDataFrame([("k", "f")], "key string, failure string")).first()) == (False, 1)


def test_distinct_first(spark):
    rows = spark.createDataFrame([(["A b", "a  B ", "", "c"],)], "v array<string>")
    assert rows.select(matching.distinct_first("v")).first()[0] == ["A b", "c"]


def test_numbers_follow_the_order(spark):
    from lodestack.operators.order import numbered

    rows = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("x"), (F.col("id") % 7).alias("y"))
    got = numbered(rows, [F.desc("y"), F.col("x")], "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (-r["y"], r["x"]))] == list(range(1, 501))
    assert numbered(rows.limit(0), ["x"], "n").count() == 0


def test_keyed_updates_take_the_last(spark):
    rows = spark.createDataFrame([("a/one.txt", 1, 2, 3, 4), ("b/two.txt", 1, 2, 3, 4), (None, 1, 2, 3, 4)], "f string, d int, m int, s int, p int")
    u = spark.createDataFrame([("one", 1, 50, None, None, None), ("e.txt", 2, 60, 70, None, None), ("", 3, 9, 9, 9, 9)], "key string, ord int, d int, m int, s int, p int")
    parts = {"desire": "d", "market": "m", "style": "s", "practicality": "p"}
    got = set(map(tuple, matching.keyed_update(rows, u, "f", parts).collect()))
    assert ("a/one.txt", 60, 70, 3, 4, 43) in got and ("b/two.txt", 1, 2, 3, 4, 2) in got
