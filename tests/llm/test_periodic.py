"""Runs, digests and collapsed texts against a search that tries every stretch and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestack.llm import periodic, queries


def brute(words):
    """Every maximal stretch of each period, less those that have a smaller one."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def wanted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    listed, left = "".join(f"{s},{m},{p}\n" for s, m, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(left))


def split_runs(words):
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    counts, _ = periodic.lag_counts(ids, np.array([0, len(ids)]))
    assert counts.tolist() == [int((ids[p:] == ids[:-p]).sum()) for p in range(1, len(ids) // 4 + 1)]
    return periodic.runs_of(ids, counts)


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed, monkeypatch):
    """Few words and nested repeats; a low bar for frequent words, so that both ways of counting meet in a text."""
    rng = random.Random(seed)
    monkeypatch.setattr(periodic, "often", lambda n: np.maximum(0, n // rng.choice([3, 10, 50])) + 2)
    for _ in range(150):
        words = []
        while len(words) < rng.choice([5, 20, 80, 300]):
            piece = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([1, 2, 3, 5, 17]))] * rng.choice([1, 1, 2, 3, 5, 9])
            words += piece if rng.random() < 0.7 or len(words) < 8 else words[-rng.randrange(1, len(words)) :] * rng.choice([1, 4, 6])
        assert split_runs(words) == brute(words)


def test_many_texts_at_once():
    rng = random.Random(9)
    texts = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 7, 300]))] for _ in range(60)]
    ids, before = np.array([w for t in texts for w in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts]))
    counts, offsets = periodic.lag_counts(ids, before)
    for t, words in enumerate(texts):
        own = np.array(words, np.int64)
        assert counts[offsets[t] : offsets[t + 1]].tolist() == [int((own[p:] == own[:-p]).sum()) for p in range(1, len(own) // 4 + 1)]
    every = {t for t, words in enumerate(texts) if brute(words)}
    assert every <= set(periodic.candidates(counts, offsets).tolist())


def test_long_texts_stay_cheap():
    """One word 400,000 times, two words at random, and a period that fills half a text."""
    rng = np.random.default_rng(1)
    assert split_quick(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    binary = rng.integers(0, 2, 200_000)
    assert all(p < 40 for _, _, p in split_quick(binary))
    block = rng.integers(0, 1000, 25_000)
    assert split_quick(np.concatenate([rng.integers(0, 1000, 50_000), block, block, block, block])) == [(50_000, 100_000, 25_000)]


def split_quick(ids):
    return periodic.runs_of(ids, periodic.lag_counts(ids, np.array([0, len(ids)]))[0])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r) for r in queries.op11_periodic(spark, "/root/testdata/sf0.001").collect()}
    assert found == {r["doc_id"]: wanted(*r) for r in docs if len((r["text"] or "").split()) < 3000} | {k: v for k, v in found.items() if k in {r["doc_id"] for r in docs if len((r["text"] or "").split()) >= 3000}}
    assert sum(v[1] > 0 for v in found.values()) >= 5


def test_odd_rows(odd):
    rows = periodic.find(odd.withColumn("runs", odd["kind"])).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == odd.count() and by[1]["kind"] == "k" and by[9]["size"] == 1 and by[2]["gone"] == "g"
    assert [by[k]["collapsed"] for k in (3, 4, 5)] == ["", "", ""] and by[3]["runs"] == [] and by[3]["text"] is None
    assert [tuple(r) for r in by[10]["runs"]] == [(0, 4000, 1)] and by[10]["collapsed"] == "word" and by[10]["n_words"] == 4000
    digests = {r["doc_id"]: r for r in periodic.digest(periodic.find(odd)).collect()}
    assert digests[10]["exponent_milli"] == 4_000_000 and digests[3]["start"] is None
