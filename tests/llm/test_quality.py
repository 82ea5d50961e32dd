"""The quality classifier: held-out accuracy, passages that decide, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.is_held_out()).select("score", "predicted", "quality").collect()
    score, truth = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert len(rows) > 100 and ((score >= 0) & (score <= 1)).all()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97
    good, bad = score[truth == 1], score[truth == 0]
    assert (good[:, None] > bad[None, :]).mean() >= 0.98


def probabilities(model, texts):
    body, at, ends, first = quality.passages(pa.array(texts))
    return model.scores(model.encode(body, at, ends), first)


def test_one_text_scores_alike_in_any_company(model):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab cde  F.\n$é"), n)) for n in (0, 1, 7, 3000, 200_000)] + ["x" * 300_000, "", " ", "word " * 65]
    alone = np.concatenate([probabilities(model, [t]) for t in texts])
    assert np.allclose(alone, probabilities(model, texts), atol=1e-5)


def test_passages_cover_whole_texts():
    texts = ["", " a ", "w " * 64, "w " * 65, None, "  \n"]
    body, at, ends, first = quality.passages(pa.array(texts))
    assert np.diff(first).tolist() == [1, 1, 1, 2, 1, 1]
    assert (ends >= at).all() and [int((ends - at)[a:b].sum()) for a, b in zip(first, first[1:])] == [len(t or "") for t in texts]


def test_bad_passages_decide(spark):
    """Bags of clean passages with one bad among them, labelled as a whole: attention finds it in longer bags too."""
    rng = np.random.default_rng(4)

    def passage(bad):
        words = ["".join(rng.choice(list("aeionrst"), 5)) + ("$$$" if bad else "") for _ in range(60)]
        return np.frombuffer(" ".join(words).encode(), np.uint8)

    def bag(bad, n):
        return [passage(bad and i == n // 2) for i in range(n)]

    model = quality.fit([(1 - b, bag(b, int(rng.integers(1, 5)))) for b in [0, 1] * 60])
    for b in (0, 1):
        parts = bag(b, 6)
        edges = np.append(0, np.cumsum([len(p) for p in parts]))
        h = model.encode(np.concatenate(parts), edges[:-1], edges[1:])
        assert (model.scores(h, np.array([0, 6]))[0] >= 0.5) == (b == 0)


def test_odd_rows(spark, odd, model):
    rows = quality.score(odd, model).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == odd.count() and by[3]["score"] == by[4]["score"] and by[3]["text"] is None and by[1]["kind"] == "k"
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x"), (4, 7, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    bags, prior = quality.training_bags(odd, labels)
    assert {q for q, _ in bags} <= {0, 1} and len(bags) <= 2 and prior == 0.0
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels.where("1 = 0"))).collect()} == {0.5}


def test_no_rows(empty, model):
    assert quality.score(empty, model).count() == 0
