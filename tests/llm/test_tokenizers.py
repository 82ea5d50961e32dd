"""Encoders against the public libraries, over a whole table."""

import hashlib

import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, models

from lodestack.llm import bpe, viterbi

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_counts_are_those_of_a_unigram_tokenizer(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unused(i))]
    own = Tokenizer(models.Unigram(pieces, unk_id=[p for p, _ in pieces].index("<unk>"), byte_fallback=True))
    docs = spark.read.parquet(DOCS)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in viterbi.token_counts(docs, path).collect():
        t = texts[r["doc_id"]]
        want = len(own.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert r["n_tokens"] == want, r["doc_id"]
    u = viterbi.vocabulary(path)
    for t in ("  two  blanks ", "日本語 ☃☃ é", "aaaaaaaaaaaaaaaaaaaaaaa", " ", "the\n\nthe", "0xFF…"):
        assert u.count(t)[1] == len(own.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), t


def test_digests_are_those_of_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = spark.read.parquet(DOCS)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = bpe.digest(docs, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        ids = own.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_a_full_cache_is_emptied_and_changes_nothing():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small, large = bpe.Codec(bpe.load_ranks(path), 2000), bpe.codec(path)
    for i in range(30):
        t = " ".join(f"word{i}x{j} and{j}" for j in range(20))
        assert small.encode(t) == large.encode(t)
    assert len(small.kept) <= 60
    bpe._forget()
    assert not large.kept
