"""The cut of estimates is one of the things that the recall of a pair counts."""

import math

import numpy as np
import pyarrow as pa

from lodestack.llm import ngramjoin
from lodestack.llm.common import word_hashes

#: Pairs of likeness 0.8, of 40000 of their kind those with the least estimates: 0.656 to 0.664.
LOW = [3570, 4926, 8880, 12559, 18003, 19586, 31191, 32712]


def pair(i):
    words = " ".join(f"w{i}x{j}" for j in range(12))
    return [f"{words} a{i}", f"{words} b{i}"]


def test_pairs_with_low_estimates_are_linked(spark):
    texts = [t for i in LOW for t in pair(i)]
    sets = list(ngramjoin.shingles(*word_hashes(pa.array(texts))))
    signed = [ngramjoin.minhash(s).astype(np.uint8) for s in sets]
    assert all((a == b).mean() < 0.67 for a, b in zip(signed[::2], signed[1::2]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(len(texts))}


def test_cut_and_runs_share_the_recall():
    cut = round(ngramjoin.bounds(0.8)[0] * ngramjoin.PLACES)
    below = sum(math.comb(ngramjoin.PLACES, k) * 0.8**k * 0.2 ** (ngramjoin.PLACES - k) for k in range(cut))
    apart = (1 - 0.8 * 0.96**2) ** ngramjoin.RUNS
    assert below + apart <= 1 - ngramjoin.RECALL
