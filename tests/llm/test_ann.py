"""Nearest neighbours: recall on a whole table, few visits where vectors lie in clusters, cells dealt out."""

import numpy as np
import pytest

from lodestack.llm import ann


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 24))
    x[::3] = x[0] + 0.01 * rng.normal(size=(1000, 24))  # a third in one place
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def recall(x, got, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in ids:
        score = u @ u[q]
        score[q] = -9
        hit += len(set(np.argsort(-score, kind="stable")[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    return hit / (5 * len(ids))


def test_recall_on_a_whole_table(spark):
    index = ann.Index(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    rows = index.rows.orderBy("id").collect()
    x, ids = np.array([r["v"] for r in rows]), [r["id"] for r in rows]
    assert ids == list(range(ids[0], ids[0] + len(ids)))
    got = index.search(index.rows.where("id % 50 = 0")).selectExpr(f"query_id - {ids[0]} query_id", f"vec_id - {ids[0]} vec_id").collect()
    assert recall(x, got, [i for i in range(len(ids)) if ids[i] % 50 == 0]) >= 0.9


def test_clusters_need_few_visits(clustered):
    x, vectors = clustered
    index = ann.Index(vectors)
    part = index.parts[24]
    assert part.visits(5) <= len(part.centroids) / 2
    got = index.search(index.rows.where("id % 50 = 0")).collect()
    assert recall(x, got, range(0, 3000, 50)) >= 0.9


def test_dealt_out_cells_agree(clustered, monkeypatch):
    index = ann.Index(clustered[1])
    asked = index.rows.where("id % 50 = 0")
    whole = index.search(asked).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "SHARE", 100)
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert index.search(asked).orderBy("query_id", "rank").collect() == whole
