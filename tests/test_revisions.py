"""Edit scripts are shortest and rebuild the newer list; exemptions hold what lies inside them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import diff
from lodestack.operators import writing


def edits(steps):
    return sum(s["dropped"] + len(s["added"]) for s in steps)


def rebuilt(old, steps):
    return [x for s in steps for x in old[s["start"] : s["start"] + s["kept"]] + s["added"]]


def least(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 22, 12])
def test_scripts(cells, monkeypatch):
    """Small blocks are solved exactly; large ones are parted and stay right, and shortest where no line is unique."""
    monkeypatch.setattr(diff, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(400):
        few = rng.choice([2, 3, 30])
        a, b = ([str(rng.randrange(few)) for _ in range(rng.randrange(25))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a for x in ([x] if rng.random() < 0.7 else rng.choice([[], [x, x], ["new"]]))]
        steps = diff.script(a, b)
        assert rebuilt(a, steps) == b
        assert edits(steps) == least(a, b) if cells > 12 else edits(steps) >= least(a, b)


def test_long_lists():
    a = [f"line {i}" for i in range(60_000)]
    b = a[:100] + ["x"] * 500 + a[200:30_000] + a[31_000:] + ["end"]
    steps = diff.script(a, b)
    assert rebuilt(a, steps) == b and edits(steps) == 100 + 500 + 1000 + 1


def test_columns(spark):
    old, new = ["a", "b", "c", "d", "e", "f"], ["a", "x", "c", "d", "e", "f", "g"]
    frame = spark.createDataFrame([(1, old, new, "own"), (2, None, ["a"], None), (3, [], [], ""), (4, old, old, "")], "k int, a array<string>, b array<string>, `c.d` string")
    found = {r["k"]: r for r in diff.with_script(frame, "a", "b").select("*", diff.unified(F.coalesce("a", F.array()), "script").alias("u"), diff.applied(F.coalesce("a", F.array()), "script").alias("n"), diff.changes("script").alias("x")).collect()}
    assert found[1]["u"] == [" a", "-b", "+x", " c", " f", "+g"] and found[1]["n"] == new and tuple(found[1]["x"]) == (1, 2) and found[1]["c.d"] == "own"
    assert found[2]["u"] == ["+a"] and found[3]["script"] == [] and found[4]["u"] == [] and found[4]["n"] == old


def test_exemptions(spark):
    """First places only, all places, overlapping and nested spans, a span over a bin's edge, hits that stick out."""
    texts = {1: "leverage here. I leverage data daily, and leverage more", 2: "leverage data leverage data", 3: "x" * 250 + " leverage data leverage", 4: None, 5: "LEVERAGE DATA daily leverage data"}
    rows = spark.createDataFrame(list(texts.items()), "k int, t string")
    hits = writing.spans(rows, "k", "t", [("r", r"\bleverage\b"), ("none", "")])
    left = lambda *e: sorted((r["k"], r["start"]) for r in writing.unexempted(hits, writing.exempt_spans(rows, "k", "t", list(e)), "k").collect())
    assert left() == sorted((k, m) for k, ms in {1: [0, 17, 42], 2: [0, 14], 3: [251, 265], 5: [0, 20]}.items() for m in ms)
    assert left(("leverage data", False)) == [(1, 0), (1, 42), (2, 14), (3, 265), (5, 20)]
    assert left(("leverage data", True)) == [(1, 0), (1, 42), (3, 265)]
    assert left(("leverage data", False), ("data leverage data", True), ("everage", True)) == [(1, 0), (1, 42), (3, 265), (5, 20)]


def test_page_classes(spark):
    long = "word " * 90
    pages = {
        "Dear Team,\nI build.\nSincerely,\nX": "coverletter", "Re: role\nI build.\nBest,\nX": "coverletter", "Dear Team, I build.": "resume", "What did you build last year?\nA lot.\nWhy do you want this role?\nYes.": "answers",
        f"What did you build last year?\n{long}": "answers", f"What did you build last year?\n{long} Skills Education": "resume", "Application for X\nHow did you hear of us?\nA friend": "answers", "": "resume", "What? Why? How?": "resume",
    }
    got = spark.createDataFrame(list(pages.items()), "t string, k string").select("t", "k", writing.page_class("t").alias("g")).collect()
    assert [(r["t"][:20], r["g"]) for r in got] == [(r["t"][:20], r["k"]) for r in got]
    text = "Jane Doe | jane@x.org | (555) 010-2000\nI led the **MVP** . It ﬁts “well” — really.\n• Built a co-\nmpany\nJane Doe\nOk."
    assert spark.createDataFrame([(text,)], "t string").select(writing.diff_sentences("t", True, signature="Jane Doe").alias("s")).first()["s"] == ["I led the MVP.", 'It fits "well", really.', "Built a company Ok."]
