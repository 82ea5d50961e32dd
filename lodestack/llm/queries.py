"""The registered queries of the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprint, katz, langid, linededup, mixing, ngramjoin, periodic, pii, quality, sequenced, viterbi
from .common import Workspace, is_train, read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    planned = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '1', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(md5(text), 'null'))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM o),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY source_size::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN source_size * 2 >= level * w THEN level END) OVER () AS least_level FROM l),
t AS (SELECT source, source_size, least(source_size * 2::DOUBLE, coalesce(least_level * w, source_size * 2::DOUBLE)) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, deleted lines and a digest of what is left of every document."""
    left = linededup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.md5("text").alias("text_md5"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM w),
f AS (SELECT s.doc_id, s.pos AS a, min(e.pos) AS b FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.pos >= s.pos AND e.cum - s.cum + s.w >= 1 GROUP BY ALL
      UNION
      SELECT e.doc_id, max(s.pos) AS a, e.pos AS b FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.pos >= s.pos AND e.cum - s.cum + s.w >= 1 GROUP BY e.doc_id, e.pos),
k AS (SELECT f.doc_id, a, b, md5(array_to_string(ls[a + 1 : b + 1], chr(10))) AS content, b - a AS m FROM f JOIN d USING (doc_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY content, m ORDER BY doc_id, a) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM e WHERE nth > 1),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted,
             coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, md5(r.text) AS text_md5
FROM documents LEFT JOIN r USING (doc_id)
"""


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz and base scores of every document by a model of the training fold."""
    return katz.score(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document by five-word shingles of likeness 0.8 or more."""
    return ngramjoin.join(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * c >= 8 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id),
k AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT r.doc_id, min(m) AS class_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links FROM r LEFT JOIN k ON k.x = r.doc_id GROUP BY r.doc_id
"""


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    index = ann.Index(read(spark, sf_dir, "embeddings"))
    return index.search(index.rows.where("id % 50 = 0"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with what learnt contexts add."""
    return pii.find(read(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and score of the best segmentation of every document under the public 32k vocabulary's scores."""
    return viterbi.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and of its edited text."""
    return fingerprint.compare_neighbours(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (~is_train(skip=0)).alias("held_out"), "lang_pred", "score", "rejected")


def with_repeats(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by the crc32 of the id, with their words from a drawn one on repeated by a drawn period."""
    h = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " "))

    # words stand in a function of their own, so that they are split once a text
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(mixing.WORD), F.lit(0))), repeated), F.lit(0))).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, a tenth of them with words repeated, and what collapsing leaves."""
    docs = read(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.digest(periodic.find(docs))


def op12_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every change of a client, applied in the order of its numbers over twelve batches."""
    columns = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
    rows = read(spark, sf_dir, "client_changes").select(*columns).distinct()
    numbered = sequenced.dense_ranks(rows, "client_id", "seq", "n", Workspace(spark, "ranks"))
    h = F.crc32(F.encode(F.coalesce(F.col("change_id").cast("string"), F.lit("")), "UTF-8"))
    dated = numbered.where(F.col("valid_at").isNotNull() & (h % 11 != 0)).withColumn("day", (sequenced.epoch_day(F.col("valid_at")) + 9 * (h % 4)).cast("int"))
    batch = F.least(F.lit(12), 1 + F.floor((F.col("day") - 19723) * 12 / 160)).cast("int")
    changes = dated.withColumn("batch", F.greatest(F.lit(1), batch)).withColumn("tie", F.xxhash64(*columns[2:]))  # days before the first are of the first batch
    done = sequenced.apply_changes(changes, 12)
    cents = F.floor(F.when(~F.isnan("balance"), F.col("balance")) * 100 + 0.5)
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), "current", "n")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by a model of the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.is_held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_mix": op1_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_katz": op3_katz,
    "op4_ngram_join": op4_ngram_join,
    "op5_ann": op5_ann,
    "op6_pii": op6_pii,
    "op7_tokens": op7_tokens,
    "op8_fingerprint": op8_fingerprint,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
    "op11_periodic": op11_periodic,
    "op12_changes": op12_changes,
    "op13_quality": op13_quality,
}
ORACLES = {"op1_mix": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_ngram_join": OP4_SQL}
