"""The pipeline's lines stage deletes short repeated runs too."""

import corpus_pipeline


def test_short_repeated_lines_go(spark):
    rows = [(1, "own words of one\nShare this page\n\nend a"), (2, "own words of two\nShare this page\n\nend b"), (3, "Share this page"), (4, "\n\nHome\nonly here\nHome"), (5, "\n \n"), (6, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "CAST(length(text) AS BIGINT) n_chars")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got[1] == rows[0][1] and got[2] == "own words of two\nend b" and 3 not in got
    assert got[4] == "\n\nHome\nonly here" and got[5] == got[6] == rows[4][1]
