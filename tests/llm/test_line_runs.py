"""Line dedup against all runs of all lines, tried one by one."""

import random

import pytest

from lodestack.llm import linededup


def by_brute_force(texts, min_words):
    lines = [t.split("\n") for t in texts]
    seen, gone = {}, set()
    runs = [(d, a, b) for d, ls in enumerate(lines) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1)]
    for d, a, b in runs:  # in the order of documents and places, so the first of a content comes first
        content = tuple(lines[d][a:b])
        if sum(len(x.split()) for x in content) < min_words:
            continue
        if seen.setdefault(content, (d, a)) != (d, a):
            gone |= {(d, p) for p in range(a, b)}
    return ["\n".join(x for p, x in enumerate(ls) if (d, p) not in gone) for d, ls in enumerate(lines)]


@pytest.mark.parametrize("min_words", [1, linededup.MIN_WORDS, 10])
def test_runs(spark, min_words):
    draw = random.Random(min_words)
    kinds = ["", "a", "b c", "one two three", "four five six seven", "d", "  ", "eight nine ten eleven twelve"]
    texts = ["\n".join(draw.choice(kinds) for _ in range(draw.randint(1, 9))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs, min_words).collect()}
    assert [got[i] for i in range(len(texts))] == by_brute_force(texts, min_words)


def test_array_prefixes_and_runs(spark):
    """The array is sorted to its end, and maximal runs are those of a search, for runs longer than one line."""
    draw = random.Random(5)
    base = [draw.randrange(3) for _ in range(30)]
    docs = [base[draw.randrange(20) :][: draw.randint(1, 20)] + [draw.randrange(4) for _ in range(4)] for _ in range(12)]
    at = [(d, p) for d, ls in enumerate(docs) for p in range(len(ls))]
    lines = spark.createDataFrame([(d, p, 1, docs[d][p], len(docs[d]) - p) for d, p in at], "seq long, pos int, w int, rank long, left int")
    work = linededup.Workspace(spark, "t")
    levels, array = linededup.suffix_array(lines, work)
    order = sorted(at, key=lambda x: (docs[x[0]][x[1] :], x))
    assert [(r["seq"], r["pos"]) for r in array.orderBy("rank", "seq", "pos").collect()] == order

    def shared(x, y):
        a, b = docs[x[0]][x[1] :], docs[y[0]][y[1] :]
        return next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))

    lcp = {(r["seq"], r["pos"]): r["lcp"] for r in linededup.common_prefixes(levels, array, work).collect()}
    assert all(lcp.get(y, 0) == n for x, y in zip(order, order[1:]) if (n := shared(x, y)) > 1)
    le = {x: max((shared(x, y) for y in at if y < x), default=0) for x in at}
    wanted = sorted((d, p, n) for (d, p), n in le.items() if n and le.get((d, p - 1)) != n + 1)
    work = linededup.Workspace(spark, "t")
    assert sorted(tuple(r)[:3] for r in linededup.maximal_runs(lines, work).collect()) == wanted
