"""Attempts of a key are folded to the last one."""

import random

from lodestack.operators import captures

SCHEMA = "k int, attempt int, status string, missing int"


def plain(tries):
    rank = {"usable": 2, "thin": 1}
    won = None
    for a, s, m in sorted(tries):
        r = rank.get(s, 0)
        if won is None or r > won[0] or r == 2 and m is not None and won[3] is not None and m < won[3]:
            won = (r, a, s, m)
    return won[1:]


def test_thousands_of_attempts(spark):
    rows = [(1, i, "failed", 3) for i in range(5000)] + [(1, 5000, "usable", 3), (1, 5001, "usable", 3), (1, 5002, "usable", 1), (2, 1, "failed", 0)]
    got = {r["k"]: tuple(r)[1:] for r in captures.fold_attempts(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert got == {1: (5002, "usable", 1), 2: (1, "failed", 0)}


def test_random_attempts_with_nulls(spark):
    rng = random.Random(7)
    rows = [(k, a, rng.choice(["usable", "thin", "failed", None]) if k % 2 else rng.choice(["thin", "failed", None]), rng.choice([None, 0, 1, 2, 3])) for k in range(300) for a in range(rng.randint(1, 9))]
    got = {r["k"]: tuple(r)[1:] for r in captures.fold_attempts(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert got == {k: plain([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
