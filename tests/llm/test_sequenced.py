"""The stateful applier against a plain walk over the same changes, odd rows among them."""

import random

import pytest
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from lodestack.llm import queries, sequenced
from lodestack.llm.common import Workspace

SCHEMA = "client_id long, change_id long, n long, day int, batch int, op string, tie long, city string, balance double, clock string, held int"


def walk(rows, batches, patience=3):
    """What the contract says, a client and a batch at a time: (client, change, n, status, batch, missed, values, current)."""
    due, held, values, last, out = {}, {}, {}, {}, []

    def pop(c, b, missed):
        while due[c] in held[c]:
            _, change, op, new = held[c].pop(due[c])
            old = values.get(c, (None, None))
            values[c] = {"I": new, "U": tuple(o if v is None else v for v, o in zip(new, old)), "D": (None, None)}.get(op, old)
            out.append([c, change, due[c], "applied", b, missed, values[c], False])
            last[c] = len(out) - 1, op
            due[c] += 1
            missed = 0

    for b in range(1, batches + 2):
        days = [r[3] for r in rows if r[4] < b]
        for c in held if days else ():
            while held[c] and (b > batches or min(x[0] for x in held[c].values()) + patience <= max(days)):
                missed, due[c] = min(held[c]) - due[c], min(held[c])
                pop(c, b, missed)
        for c, change, n, day, _, op, tie, *new in sorted((r for r in rows if r[4] == b), key=lambda r: (r[3], r[1] is None, r[1] or 0, r[6])):
            due.setdefault(c, 1), held.setdefault(c, {})
            if n < due[c] or n in held[c]:
                out.append([c, change, n, "rejected", b, 0, (None, None), False])
            else:
                held[c][n] = day, change, op, tuple(new)
                pop(c, b, 0)
    for at, op in last.values():
        out[at][-1] = op != "D"
    return sorted(map(repr, out))


def got(frame):
    return sorted(repr([r["client_id"], r["change_id"], r["n"], r["status"], r["batch"], r["missed"], (r["city"], r["balance"]), r["current"]]) for r in frame.collect())


@pytest.mark.parametrize("keep", [10_000, 2])
def test_equals_a_plain_walk(spark, keep):
    """Clients in gaps, a null one, null ids, numbers twice in a batch and across batches, null values and odd ops."""
    rng = random.Random(keep)
    rows = []
    for i in range(400):
        day = rng.randrange(40)
        rows.append((rng.choice([None, 1, 1, 1, 0, 2, 3, 4, 5, -(2**63)]), None if i % 37 == 0 else 2**62 + i, rng.randrange(1, 60), day, 1 + day // 10, rng.choice(["I", "U", "U", "U", "D", None, "x"]), i, rng.choice([None, "a", "b"]), rng.choice([None, 1.5, -2.0])))
    frame = spark.createDataFrame([(*r, "own", i) for i, r in enumerate(rows)], SCHEMA)
    assert got(sequenced.apply_changes(frame, 4, keep=keep)) == walk(rows, 4)


def test_no_rows_and_no_settings_left(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    nulls = spark.createDataFrame([(1, 1, None, 3, 1, "I", 0, "a", 1.0, "c", 1), (1, 2, 1, None, 1, "I", 0, "a", 1.0, "c", 1)], SCHEMA)
    assert sequenced.apply_changes(nulls, 1).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_dense_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(-20, 20)])) for _ in range(300)]
    found = sequenced.dense_ranks(spark.createDataFrame(rows, "k long, o long"), "k", "o", "n", Workspace(spark, "t")).collect()
    order = {k: sorted({o for j, o in rows if j == k}, key=lambda o: (o is None, o or 0)) for k, _ in rows}
    assert sorted(map(repr, found)) == sorted(repr(r) for r in spark.createDataFrame([(k, o, order[k].index(o) + 1) for k, o in rows], "k long, o long, n long").collect())


def test_query_takes_every_distinct_row(spark):
    sf = "/root/testdata/sf0.001"
    wanted = spark.read.parquet(f"{sf}/client_changes.parquet").distinct().where("valid_at IS NOT NULL AND crc32(encode(cast(change_id AS string), 'UTF-8')) % 11 <> 0")
    found = queries.op12_changes(spark, sf)
    assert found.count() == wanted.count() and found.select("change_id").exceptAll(wanted.select("change_id")).isEmpty()
    assert found.where("current").groupBy("client_id").count().where("count > 1").isEmpty()


class _State:
    """A state that counts the calls to it."""

    calls = 0

    def __init__(self):
        self.kept = []

    def get(self):
        _State.calls += 1
        return iter(self.kept)

    def put(self, rows):
        _State.calls += 1
        self.kept = rows

    def exists(self):
        _State.calls += 1
        return bool(self.kept)

    def clear(self):
        _State.calls += 1
        self.kept = []


def test_calls_to_the_state_are_shared_by_the_clients_of_a_bucket():
    """Calls of a batch don't grow with its clients, whether they have changes or the clock alone."""
    handle = type("Handle", (), {"getListState": lambda *_: _State(), "getMapState": lambda *_: _State(), "getValueState": lambda *_: _State()})()
    applier = sequenced.Applier(T.StructType().add("city", "string"), 2)
    applier.init(handle)
    change = {"change_id": 5, "op": "I", "day": 3, "tie": 0, "city": "a"}
    fed = [(0, c, 1, change | {"n": n}) for c in range(500) for n in (1, 3)] + [(0, c, 1, None) for c in range(250)]
    _State.calls = 0
    applied = list(applier.handleInputRows((0,), iter(fed), None))
    assert [r.client_id for r in applied] == list(range(500)) and {r.n for r in applied} == {1}
    assert list(applier.handleInputRows((0,), iter([(0, c, 5, None) for c in range(500)]), None)) == []
    assert {(r.n, r.missed) for r in applier.handleInputRows((0,), iter([(0, c, 6, None) for c in range(500)]), None)} == {(3, 1)}
    assert _State.calls < 20


def test_a_start_a_batch_and_none_for_the_end(spark, monkeypatch):
    """The waits that the last batch leaves end in its own start: every start opens the state of every partition."""
    starts, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda *a, **b: starts.append(a[1:]) or start(*a, **b))
    rows = [(1, 1, 1, 1, 1, "I", 0, "a", 1.0), (1, 2, 3, 1, 1, "U", 1, "b", None), (2, 3, 2, 30, 2, "I", 2, "c", 2.0), (2, 4, 4, 30, 2, "D", 3, None, None)]
    assert got(sequenced.apply_changes(spark.createDataFrame([(*r, "own", 0) for r in rows], SCHEMA), 2)) == walk(rows, 2)
    assert len(starts) == 2
