"""From raw documents to tokens: language ID, line dedup, near-duplicate join, mixing, byte-level BPE.

Every stage works on all that its predecessor kept, which is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, langid, linededup, mixing, ngramjoin
from lodestack.llm.common import Workspace
from lodestack.operators.order import numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a repeated run of lines must have to go: every run that holds a word.
LINE_WORDS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a missing language is filled with the predicted one.

    Null texts and texts without a letter are rejected. Repeated rows are judged alike; without any labelled document
    every one is rejected. An empty table gives no rows; columns other than those of documents go."""
    found = langid.predict(docs, langid.train(docs)).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which no word is left go."""
    left = linededup.dedup(docs, LINE_WORDS).where((F.col("n_deleted") == 0) | F.col("text").rlike(mixing.WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram join, that of the least id.

    Rows of one id and text are one document; rows of one id with other texts are others, each with its own class.
    Rows without an id come last in the order of ids, so they stay where no document with an id is in their class.
    Null and empty texts have no partners and stay, once an id. An empty table gives no rows; columns other than those
    of documents go."""
    ids = docs.agg(F.count("doc_id").alias("named"), F.count_distinct("doc_id").alias("different"), F.count("*").alias("rows")).first()
    if ids["named"] == ids["different"] == ids["rows"]:
        named, key = docs, "doc_id"
    else:  # numbers in the order of ids stand for rows
        once = docs.dropDuplicates(["doc_id", "text"])
        named, key = numbered(once, [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], "_row"), "_row"
    classes = Workspace(spark, "classes").table("classes", ngramjoin.join(named.select(F.col(key).alias("doc_id"), "text")))
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept"))
    return named.join(kept.hint("merge"), F.col(key) == F.col("_kept"), "left_semi").select(*COLUMNS)  # ids have no bound to broadcast by


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its coin say.

    A null source is one of its own; a source without words takes no part. Repeated rows draw alike. An empty table
    gives no rows; columns other than those of documents go."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every copy. Null and empty texts have none; an empty table gives no rows."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), offsets=False)
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixed", mixed), ("tokens", tokens)]

#: SQL can't express the classifier, the random signatures or the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder before the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
