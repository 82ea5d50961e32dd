"""Batches in a folder: data first, the manifest that publishes it last, and scans of what is published."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.captures import status_counts

MANIFEST = T.StructType().add("batch", "string").add("try", "string").add("status", "string").add("n", "long")


def valid_name(batch: str) -> bool:
    """A batch is named after a day (MM-DD-YY), maybe with a dash and a word behind it."""
    found = re.fullmatch(r"(\d\d)-(\d\d)-\d\d(-\w+)?", batch)
    return bool(found) and 1 <= int(found[1]) <= 12 and 1 <= int(found[2]) <= 31


def stage(entries: DataFrame, root: str, batch: str, attempt: str) -> DataFrame:
    """entries as a batch's data, seen by no scan until it is published; gives the counts by status.

    attempt names the try, so that one that stopped half way leaves nothing in the next one's folder."""
    if not valid_name(batch):
        raise ValueError(f"no batch name: {batch}")
    at = f"{root}/data/batch={batch}/try={attempt}"
    entries.drop("batch", "try").write.mode("overwrite").parquet(at)
    return status_counts(entries.sparkSession.read.parquet(at))


def publish(entries: DataFrame, root: str, batch: str, attempt: str) -> None:
    """Stages entries and then writes the batch's manifest, one file that names the try and counts statuses, zeros
    included. Publishing a batch again replaces it as its new manifest appears."""
    counts = stage(entries, root, batch, attempt)
    named = counts.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("try"), F.col("status"), F.col("n").cast("long").alias("n"))
    named.coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{batch}")  # a row a status


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(batch, try, status, n) of all published batches; a damaged line counts as none."""
    found = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(f"{root}/manifests")
    return found.where("batch IS NOT NULL AND try IS NOT NULL")


def published(spark: SparkSession, root: str, batches: list[str] | None = None) -> DataFrame:
    """The entries of published tries alone, with batch and try; of batches only, where these are given.

    batch and try are folders, so names given and, at run time, tries without a manifest are left out before any of
    their files is opened."""
    rows = spark.read.option("basePath", f"{root}/data").option("mergeSchema", "true").schema(_schema(spark, root)).parquet(f"{root}/data")
    told = manifests(spark, root).select("batch", "try").distinct()
    if batches is not None:
        rows, told = rows.where(F.col("batch").isin(batches)), told.where(F.col("batch").isin(batches))
    return rows.join(told, ["batch", "try"], "left_semi")


def _schema(spark: SparkSession, root: str) -> T.StructType:
    """The data's schema with both folders' names as text."""
    found = spark.read.option("basePath", f"{root}/data").option("mergeSchema", "true").parquet(f"{root}/data").schema
    own = [f for f in found if f.name not in ("batch", "try")]
    return T.StructType([*own, T.StructField("batch", T.StringType()), T.StructField("try", T.StringType())])
