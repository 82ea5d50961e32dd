"""Operators that SQL can't express, against brute force over whole small texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lodestack.llm import ann, components, fingerprint, katz, langid, ngramjoin, pii, queries, viterbi
from lodestack.llm.common import Workspace

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    rows = []
    for i in range(140):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(text)))
        if i % 3 == 0 and text:
            for j in range(i % 4):
                near = list(text)
                near[rng.randrange(len(near))] = rng.choice(words)
                rows.append((1000 + 10 * i + j, " ".join(near)))
    passage = " ".join(words[:30])
    rows += [(5000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(i % 40))) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_katz(docs):
    rows = [tuple(r) for r in docs.collect()]
    tokens = lambda t: re.findall(WORD, t.lower()) + ["</s>"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    d = katz.discounts([sum(c == k for c in bi.values()) for k in range(1, katz.K + 2)])
    follow = defaultdict(dict)
    for (h, w), c in bi.items():
        follow[h][w] = c

    def p(h, w):
        f = follow.get(h)
        if not f:
            return base(w)
        total = sum(f.values())
        lost = sum(c * (1 - d[c]) for c in f.values() if c <= katz.K)
        left = 1 - sum(map(base, f))
        if w in f:
            return f[w] * (d[f[w]] if lost > 0 and f[w] <= katz.K else 1) / (total if lost > 0 else total + 1)
        return (lost / total if lost > 0 else 1 / (total + 1)) / left * base(w)

    for h in list(follow)[:20]:
        assert math.isclose(sum(p(h, w) for w in uni) + p(h, "\0"), 1, abs_tol=1e-9)
    got = {r["doc_id"]: r for r in katz.score(docs).collect()}
    for i, t in rows:
        w = tokens(t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(base(x)) for x in w), abs_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], w)), abs_tol=1e-9)


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, over = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                over[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted((d, min(least[root(i)]), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("small", "block", "leaders", "share"), [(64, 1024, 32, 4096), (4, 5, 32, 3), (3, 1024, 2, 5), (2, 7, 1, 4096)])
def test_ngram_join(docs, monkeypatch, small, block, leaders, share):
    for name, value in (("SMALL", small), ("BLOCK_SETS", block), ("LEADERS", leaders), ("SHARE", share)):
        monkeypatch.setattr(ngramjoin, name, value)
    assert sorted(map(tuple, ngramjoin.join(docs).collect())) == brute_join([tuple(r) for r in docs.collect()])


def test_runs_reach_the_recall():
    assert ngramjoin.RUNS >= 10
    assert ngramjoin.runs_for(0.8, 0.99, 128, 2, 1) < ngramjoin.runs_for(0.8, 0.99, 128, 2, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c")
    found = {r["node"]: r["label"] for r in got.collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 1200)] + rng.normal(scale=0.3, size=(1200, 16))
    x[700] = x[100]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(vectors)
    got = defaultdict(list)
    for r in index.search(index.rows.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    norm = np.sqrt((x * x).sum(1))
    hit = 0
    for q in range(0, 1200, 50):
        score = (x * x[q]).sum(1) / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((np.arange(1200), -score))[:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(score[i] - s) < 1e-12 for i, s in got[q]) and len(got[q]) == 5
    assert hit >= 0.9 * 5 * 24
    assert got[100][0][0] == 700


def test_query_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    index = ann.Index(vectors)
    whole = index.search(index.rows.where("id % 20 = 0")).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "BLOCK", 4)
    assert index.search(index.rows.where("id % 20 = 0")).orderBy("query_id", "rank").collect() == whole


def naive_spans(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    n = lambda m: sum(c.isdigit() for c in m[0])
    tests = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 16 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])), lambda m: 8 <= n(m) <= 15]
    return [[m.span() for m in re.finditer(p, t) if ok(m)] for p, ok in zip(patterns, tests)]


def test_fixed_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1029.@-+ ()%_é:,") for _ in range(rng.randint(0, 30)))
        assert pii.base(t) == naive_spans(t), t
    for t in ("4111 1111 1111 1111", "call +1 (555) 010-2000.", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "256.1.1.1", "a" * 100_000, "1" * 100_000, "+" * 50_000, "1." * 50_000):
        assert pii.base(t) == (naive_spans(t) if len(t) < 1000 else pii.base(t))


def test_contexts_reveal_others(spark):
    rows = [(i, f"Hello friend, please call me at +1 (555) 010-{1000 + i} today") for i in range(6)]
    rows += [(10, "so call me at 555-010-7777 now"), (12, "serial number 555-010-7777"), (13, "write to jane.doe@example.org")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10]["spans"] == "phone:14:26" and got[10]["n_phone"] == 1 and got[12]["spans"] == ""
    assert got[10]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[13]["base_sha256"] == hashlib.sha256(got[13]["spans"].encode()).hexdigest()


def test_viterbi():
    u = viterbi.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {p: s for p, (_, s) in u.machine.items()}

    def brute(text):
        best = [(0.0, [])] + [None] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                w = text[s:e]
                score = pieces.get(w, u.unknown if e - s == 1 else None)
                if score is not None and best[s] is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                    best[e] = best[s][0] + score, best[s][1] + [w]
        return best[-1][0], sum(1 if w in pieces else len(w.encode()) for w in best[-1][1])

    rng = random.Random(2)
    for _ in range(150):
        t = "".join(rng.choice(["the", " ", "  ", "ing", "é", "日", "\n", "x", "Theater", "😀", "an", "12"]) for _ in range(rng.randint(1, 14)))
        assert u.count(t) == brute(viterbi.MARK + t.replace(" ", viterbi.MARK)), t


def test_viterbi_ties_and_unknown_runs():
    u = viterbi.Unigram({"a": -1.0, "aa": -2.0, "b": -1.0, "ab": -2.0}, byte_fallback=False)
    assert u.best("aa") == (-2.0, 1)
    assert u.best("aab") == (-3.0, 2)
    assert u.best("a??b") == (-2.0 + 2 * u.unknown, 3)


def naive_phrases(t):
    seen, a = set(), 0
    for e in range(1, len(t) + 1):
        if t[a:e] not in seen:
            seen.add(t[a:e])
            a = e
    return seen


def test_fingerprints(docs):
    rows = sorted((tuple(r) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs).collect()}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        starts, end, _, signed = fingerprint.fingerprinted(t)
        assert {t[a:b] for a, b in zip(starts, [*starts[1:], end])} == naive_phrases(t)
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        again = fingerprint.fingerprinted(edited)[3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == signed.astype(">u4").tobytes().hex() and r["edited_fingerprint"] == again.astype(">u4").tobytes().hex()
        a, b = naive_phrases(t), naive_phrases(edited)
        if max(len(a), len(b)) < fingerprint.KEPT // 2 and a | b:
            assert math.isclose(r["near_edited"], len(a & b) / len(a | b))
        assert 0 <= r["near_next"] <= 1


def test_single_document_is_its_own_next(spark):
    r = fingerprint.compare_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_language_held_out(spark):
    found = queries.op10_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)


def test_language_ignores_other_columns(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(d)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d.selectExpr("doc_id", "text", "'xx' lang", "'y' source"), model).collect()}
    assert a == b
