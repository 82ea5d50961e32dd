"""The scan against the pattern, the merges against the encoder, and round trips."""

import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "٣", "!", ".", " ", "　", "日", "😀", "'ll", "'re", "\r\n", "​", "́", "\u0085"]


@pytest.fixture(scope="module")
def both():
    c = bpe.codec(PATH)
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_boundaries_of_many_texts_at_once(both):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    pattern = regex.compile(P.PATTERN)
    assert both[0].pieces(texts) == [pattern.findall(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET) | st.characters(exclude_categories=["Cs"]), max_size=60).map("".join))
def test_ids_and_round_trip(text):
    c = bpe.codec(PATH)
    ids = c.encode(text)
    assert ids == tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={}).encode_ordinary(text)
    assert c.decode(ids).decode() == text
    at = c.offsets(ids)
    k = len(ids) // 2
    assert c.decode(ids[k:]) == text.encode()[at[k] :]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "!" * 2000, " " * 3000, "日本" * 2000, "x" * 70, "\n" * 999 + "a"])
def test_long_pieces(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_full_cache_is_emptied(both):
    small = bpe.Codec(both[0].ranks, cache=10)
    for n in range(50):
        text = f"word{n} other{n * n} thing"
        assert small.encode(text) == both[1].encode_ordinary(text)
    assert len(small.kept) <= 16


def test_tables_round_trip(spark):
    rows = [(1, "Hello, world! 日本"), (2, ""), (3, "don't  stop\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == rows
