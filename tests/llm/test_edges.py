"""Every operator over odd rows and over none: defined results, no crash."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, bpe, fingerprint, katz, langid, linededup, mixing, ngramjoin, periodic, pii, quality, viterbi

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "mix": mixing.plan_mix, "dedup": linededup.dedup, "katz": katz.score, "join": ngramjoin.join, "pii": pii.find, "counts": lambda d: viterbi.token_counts(d, PIECES),
    "fingerprint": fingerprint.compare_neighbours, "bpe": lambda d: bpe.digest(d, BPE), "langid": lambda d: langid.predict(d, langid.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(odd, name):
    assert OPERATORS[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, name):
    assert OPERATORS[name](empty).count() == 0


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}


def test_defined_results(odd):
    nothing = hashlib.sha256(b"").hexdigest()
    counts = by_id(OPERATORS["bpe"](odd))
    assert counts[3]["n_tokens"] == counts[4]["n_tokens"] == 0 and counts[3]["ids_sha256"] == counts[4]["decoded_sha256"] == nothing
    sizes = by_id(mixing.plan_mix(odd))
    assert sizes[3]["size"] == sizes[5]["size"] == 0 and sizes[10]["size"] == 4000 and sizes[2]["source"] is None
    assert sizes[2]["source_size"] == 14 and all(r["copies"] <= 2 for r in sizes.values())
    lines = by_id(linededup.dedup(odd))
    assert lines[3]["text"] is None and lines[3]["n_lines"] == 0
    assert lines[9]["text"] == "" and lines[2]["text"] == "intro line" and lines[1]["n_deleted"] == 0 and lines[7]["n_deleted"] == 0
    assert lines[9]["size"] == 1 and lines[9]["kind"] == "k"
    found = by_id(pii.find(odd))
    assert (found[7]["n_email"], found[7]["n_phone"], found[3]["spans"]) == (1, 1, "")
    groups = by_id(ngramjoin.join(odd))
    assert groups[9]["class_id"] == 1 and groups[9]["n_links"] == groups[1]["n_links"] == groups[7]["n_links"] == 1
    assert groups[3]["class_id"] == 3 and groups[5]["n_links"] == 0
    langs = by_id(langid.predict(odd, langid.train(odd)))
    assert langs[3]["lang_pred"] == langs[4]["lang_pred"] == langs[5]["lang_pred"] == "und" and langs[3]["rejected"]
    prints = by_id(fingerprint.compare_neighbours(odd))
    assert prints[1]["fingerprint"] == prints[9]["fingerprint"] and prints[3]["fingerprint"] == "" and prints[4]["near_next"] == 1.0
    scores = by_id(katz.score(odd))
    assert scores[3]["n_tokens"] == 1 and scores[10]["n_tokens"] == 4001
    learnt = [r for r in scores.values() if not r["held_out"]]
    assert sum(r["score"] for r in learnt) > sum(r["base_score"] for r in learnt)
    assert by_id(viterbi.token_counts(odd, PIECES))[4]["n_tokens"] == 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1e30, 1e30]), (9, [0.9, 0.1]), (50, [1.0, 2.0, 3.0]), (9, [0.9, 0.1]), (10, [-1e160, 1e159]), (11, [-1e-170, 0.0])]
    index = ann.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in index.search(index.rows.where("id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 8), (0, 4, 10), (0, 5, 11)]
    scores = {r["vec_id"]: r["score"] for r in index.search(index.rows.where("id = 11")).collect()}
    assert scores[0] == -1.0 and abs(scores[10] - 10 / 101**0.5) < 1e-15 and set(scores) == {0, 1, 8, 9, 10}
    none = ann.Index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.search(none.rows).count() == 0


@pytest.mark.parametrize("name", ["mix", "dedup", "langid", "quality", "periodic"])
def test_columns_of_the_caller_stay(odd, name):
    """Columns that clash with an operator's own names, and names with dots, come back as they were."""
    run = {
        "mix": mixing.mix, "dedup": linededup.dedup, "langid": lambda d: langid.predict(d, None), "quality": lambda d: quality.score(d, None), "periodic": periodic.find,
    }[name]
    own = {"mix": set(), "dedup": {"n_lines", "n_deleted"}, "langid": {"lang_pred", "score", "rejected"}, "quality": {"score", "predicted"}, "periodic": {"n_words", "runs", "collapsed"}}[name]
    named = ["t1", "t2", "_id", "_t1", "_t2", "_lines", "_left", "_copy", "_bin", "_salt", "_source", "_draw", "rate", "target", "source_size", "copies", "size", "gone", "a.b", "k"]
    wide = odd.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in named])
    rows = run(wide).collect()
    assert rows and set(rows[0].asDict()) == set(wide.columns) | own
    for r in rows:
        assert all(r[n] == (f"{n} {r['doc_id']}" if r["doc_id"] is not None else None) for n in named if n not in own)


def test_other_counts_of_neighbours(spark):
    """Cells to visit are fitted for the number of neighbours that is asked for."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 24))
    index = ann.Index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for k in (5, 40):
        found = {}
        for r in index.search(index.rows.where("id % 30 = 0"), k=k).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = [len(found[q] & set(np.argsort(-(unit @ unit[q]), kind="stable")[1 : k + 1].tolist())) / k for q in range(0, 3000, 30)]
        assert np.mean(hits) >= 0.9
