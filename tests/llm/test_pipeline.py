"""The pipeline's stages against brute force and in their order."""

import public_tokenizers

import corpus_pipeline
from lodestack.llm import bpe

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixed", "tokens"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SMALL)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    raw, lang, lines, near, mixed, tokens = [k.collect() for k in kept]
    assert len(lang) >= 0.99 * len(raw)
    assert {r["doc_id"] for r in lines} <= {r["doc_id"] for r in lang} and all(r["text"].strip() and r["n_chars"] == len(r["text"]) for r in lines if r["n_chars"])
    texts = [r["text"] for r in near]
    assert len(texts) == len(set(texts))
    from test_brute import brute_join

    classes = brute_join([(r["doc_id"], r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, c, _ in classes if d == c)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    copies = [sum(1 for m in mixed if m["doc_id"] == r["doc_id"]) for r in near[:30]]
    assert max(copies) <= 2
    c = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text_of = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed) and all(c.decode(r["token_ids"]).decode() == text_of[r["doc_id"]] and r["n_tokens"] == len(r["token_ids"]) for r in tokens)


def test_rows_without_ids_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (None, long), (None, "alone " + long[::-1]), (None, "alone " + long[::-1]), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "CAST(length(text) AS BIGINT) n_chars")
    got = sorted(corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect(), key=str)
    assert [(r["doc_id"], r["text"][:5]) for r in got] == [(1, "w0 w1"), (2, "short"), (None, "alone")]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
