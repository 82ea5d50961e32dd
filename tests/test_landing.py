"""Settings over defaults, captures by name, streams with stops, cells rewritten in place and published batches."""

import glob
import json
import os
import random

from pyspark.sql import functions as F

from lodestack.operators import locate, log, settings, tracker
from lodestack.sources import batches, files
from lodestack.streaming import log as streams

DEFAULTS = {"a": 1, "b": {"c": "x", "d": {"e": [1], "f": None}, "g": {}}, "it's": {"k.l": 2}}


def _some(rng, deep=0):
    kind = rng.randrange(8 if deep < 4 else 5)
    if kind < 5:
        return [None, 7, "ü", [1, {"a": 2}], {}][kind]
    return {k: _some(rng, deep + 1) for k in rng.sample(["a", "b", "c", "d", "e", "f", "g", "it's", "k.l", "z"], rng.randint(0, 5))}


def test_settings_are_merged_as_dicts(spark):
    rng = random.Random(5)
    docs = [_some(rng) for _ in range(400)]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    got = spark.createDataFrame(texts, "i int, t string").select("i", F.to_json(settings.over_defaults(F.col("t"), DEFAULTS)).alias("m")).collect()
    assert {r["i"]: json.loads(r["m"]) for r in got} == {i: files.settings(d if isinstance(d, dict) else {}, DEFAULTS) for i, d in enumerate(docs)}


def test_unreadable_settings_are_defaults(spark):
    texts = [None, "", " ", "3", "null", "[1]", '{"a": 2} x', '{"a": 2}]', '{"a": 2}}', '{"a": 2}, {"a": 3}', '{"a": 2}], [{}', '{"a": 2}, "w": 2', '{"a": 2, "a": 3}', '{"a": 2']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [json.loads(r[0]) for r in rows.select(F.to_json(settings.over_defaults(F.col("t"), DEFAULTS))).collect()] == [DEFAULTS] * len(texts)
    assert [r[0] for r in rows.select(settings.overrides(F.col("t"), DEFAULTS)).collect()] == [[]] * len(texts)
    own = spark.createDataFrame([(' {"b": {"d": 4}, "it\'s": {"k.l": 3}} ',)], "t string")
    assert own.select(settings.overrides(F.col("t"), DEFAULTS)).first()[0] == ["b.d.e", "b.d.f", "it's.k.l"]
    assert own.select(F.to_json(settings.over_defaults(F.col("t"), {}))).first()[0] == '{"b":{"d":4},"it\'s":{"k.l":3}}'


def _located(name, base, paths, source=("sources", "captures")):
    if name is None or not name.strip():
        return None
    name, last = name.strip(), name.strip().split("/")[-1]
    under = lambda f, n: n if n.startswith("/") or f == "" else f"{f}/{n}"
    above = None if base is None else base.rpartition("/")[0]
    places = [name] if base is None else [name, under(base, name), under(above, name), under(above, "/".join([*source, last]))]
    for rank, p in enumerate(places):
        if p in paths:
            return p, rank
    roots = [] if base is None else [base] + ([above] if above and any(p.startswith(under(above, source[0]) + "/") for p in paths) else [])
    for rank, root in enumerate(roots, 4):
        hits = [p for p in paths if p.startswith(f"{root}/") and p.split("/")[-1] == last]
        if hits:
            return min(hits, key=lambda p: (p.count("/"), p)), rank
    return None


def test_index_of_files_is_dealt_out(spark):
    rows = spark.createDataFrame([(1, "a.txt", "b/rank")], "id int, name string, base string")
    found = locate.locate(rows, spark.createDataFrame([("b/rank/a.txt",)], "path string"), "id")
    assert [tuple(r) for r in found.collect()] == [(1, "b/rank/a.txt", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_locate_is_the_walk(spark):
    rng = random.Random(6)
    folder = lambda: "/".join(rng.choice(["a", "b", "sources", "captures", "rank"]) for _ in range(rng.randint(0, 4)))
    at = lambda f, n: f"{f}/{n}" if f else n
    paths = {at(folder(), rng.choice("xyz") + ".txt") for _ in range(60)} | {"/x.txt", "/a/y.txt"}
    rows = [(i, rng.choice([at(folder(), rng.choice("xyzw") + ".txt"), rng.choice("xyzw") + ".txt", "/x.txt", " ", None]), rng.choice([folder() or "a", "a/rank", "b/rank", None])) for i in range(2000)]
    listing = spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "path string")
    got = locate.locate(spark.createDataFrame(rows, "id int, name string, base string"), listing, "id")
    want = {i: _located(n, b, paths) for i, n, b in rows}
    assert {r["id"]: (r["path"], r["rank"]) for r in got.collect()} == {i: w for i, w in want.items() if w}
    assert {w[1] for w in want.values() if w} == {0, 1, 2, 3, 4, 5}
    assert locate.locate(spark.createDataFrame(rows, "id int, name string, base string"), listing.limit(0), "id").count() == 0


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(5), rng.randrange(9), f"u{i}", rng.random() < 0.6, i) for i in range(120)]
    events = spark.createDataFrame(rows, "key long, at long, url string, ok boolean, seq long").select("key", F.timestamp_seconds("at").alias("fetched_at"), "url", "ok", "seq")
    order, folder = rng.sample(range(120), 120), f"file://{tmp_path}"
    for n in range(3):
        events.where(F.col("seq").isin(order[n * 40 : n * 40 + 40])).repartition(3).write.mode("append").parquet(f"{folder}/events")
        if n == 1:  # a start that dies while it writes its second micro-batch
            before = streams.states
            try:
                streams.states = lambda e: before(e).withColumn("url_", F.expr("CASE WHEN n_events > 12 THEN raise_error('stop') END"))
                streams.advance(spark, f"{folder}/events", events.schema, folder, files=1)
            except Exception as e:  # noqa: BLE001
                assert "stop" in str(e)
            finally:
                streams.states = before
        streams.advance(spark, f"{folder}/events", events.schema, folder, files=2)
        streams.advance(spark, f"{folder}/events", events.schema, folder)  # nothing new
    got, want = streams.current(spark, folder), log.state(events)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_cells_are_rewritten_where_they_change(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, ["a", "b", None][i % 3], f" v{i}" if i % 3 != 1 and i % 2 else f"v{i}") for i in range(60)]
    spark.createDataFrame(rows, "i int, part string, v string").write.partitionBy("part").parquet(path)
    fixes = {"v": F.trim("v"), "missing": F.lit(1)}
    table = lambda: {(f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/part=*/*.parquet")}
    before = table()
    changes = tracker.cell_changes(spark.read.parquet(path), fixes, ["i"]).collect()
    assert {(r["i"], r["column"], r["old"], r["new"]) for r in changes} == {(i, "v", v, v.strip()) for i, _, v in rows if v.startswith(" ")}
    assert tracker.rewrite_changed(spark, path, "part", fixes) == len(changes) == 20
    after = table()
    assert {f for f in before & after} == {f for f in before if "part=b" in f[0]}
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("i", "v").collect()) == [(i, v.strip()) for i, _, v in rows]
    assert tracker.rewrite_changed(spark, path, "part", fixes) == 0 and table() == after


def test_half_written_batches_are_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}"
    entry = lambda *rows: spark.createDataFrame(list(rows), "id int, status string")
    batches.publish(entry((1, "usable"), (2, "thin")), root, "01-05-24", "a")
    batches.stage(entry((3, "usable")), root, "01-06-24", "a")
    batches.stage(entry((9, "failed")), root, "01-05-24", "b")
    seen = lambda **k: sorted(r["id"] for r in batches.published(spark, root, **k).collect())
    assert seen() == [1, 2]
    batches.publish(entry((4, "failed")), root, "01-05-24", "c")  # replaces
    batches.publish(entry((3, "usable")), root, "01-06-24", "b")
    assert seen() == [3, 4] and seen(batches=["01-06-24"]) == [3]
    assert {(r["batch"], r["status"]): r["n"] for r in batches.manifests(spark, root).where("n > 0").collect()} == {("01-05-24", "failed"): 1, ("01-06-24", "usable"): 1}
    assert batches.manifests(spark, root).count() == 10
    assert [batches.valid_name(n) for n in ("01-05-24", "12-31-24-two", "13-01-24", "1-5-24", "01-05-24/x")] == [True, True, False, False, False]
