"""Rejection: languages that the model never saw and letters in no order go, learned languages stay."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lodestack.llm import langid


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").select("text", "lang").collect()
    out = []
    for text, lang in docs:
        hits = langid.subwords(text)
        at = np.flatnonzero(hits)
        if len(at) > 1:
            out.append((lang, at, hits[at], text))
    return out


def judged(model, texts):
    """The share of long enough texts that are rejected."""
    gone = []
    for t in texts:
        hits = langid.subwords(t)
        if hits.sum() >= langid.ENOUGH:
            p = model.probabilities(hits)
            k = int(np.argmax(p))
            gone.append(p[k] < model.least or model.strange(hits, k))
    assert len(gone) >= 20
    return sum(gone) / len(gone)


def test_unlearned_languages_and_junk_go(rows):
    by = defaultdict(list)
    for lang, _, _, text in rows:
        by[lang].append(text)
    rng = random.Random(2)
    model = langid.fit([r[:3] for r in rows])
    assert judged(model, [r[3] for r in rows]) <= 0.005
    assert judged(model, ["".join(rng.sample(t, len(t))) for t in by["en"][:100]]) >= 0.95
    for lang, texts in by.items():
        without = langid.fit([r[:3] for r in rows if r[0] != lang])
        assert judged(without, texts) >= 0.9, lang


def test_no_floor_without_enough():
    at, n = np.array([1, 2]), np.array([3, 4])
    model = langid.fit([("a", at, n)] * 3)
    assert model.floor == -np.inf and not model.strange(np.full(langid.BUCKETS, 5), 0)
