"""File listings: duplicate artifacts, readable ones, migrations planned as rows, changed files that matter, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, has, strip, strings

# Paths that a self-maintenance commit touches.
MAINTENANCE = ["docs/changelog.md", "docs/drift-report.md", "scripts/README.md", "scripts/doc_synthesis.py", "scripts/doc_synthesis_core.py", "tests/test_doc_synthesis.py"]
SYNTHESIS = "scripts/doc_synthesis"
# Last steps of paths that list postings.
LISTINGS = ["jobs", "job", "search", "all-jobs", "openings", "open-roles"]


def stem(path) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"^.*/", ""), r"\.[^.]{1,5}$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]{1,5})$", 1))


def duplicate_artifacts(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """(folder, stem, n, only_pdf): artifacts of one normalised name in more than one format."""
    key = F.regexp_replace(F.lower(stem(path)), r"[\s_-]+", "")
    found = files.groupBy(folder, key.alias("stem")).agg(F.count_distinct(extension(path)).alias("n"), F.bool_and(extension(path) == "pdf").alias("only_pdf"))
    return found.where("n > 1")


def readable(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """(path, status, pdf) of every `.pages` file: the PDF of its stem, blanks aside, but never a FULL bundle."""
    key = F.regexp_replace(F.lower(stem(path)), r"\s+", "")
    pdfs = files.where((extension(path) == "pdf") & ~F.lower(stem(path)).rlike(r"full$")).groupBy(F.col(folder).alias("_f"), key.alias("_k")).agg(F.min(path).alias("pdf"))
    pages = files.where(extension(path) == "pages").select(folder, path, key.alias("_own"))
    joined = pages.join(pdfs, (F.col(folder) == F.col("_f")) & (F.col("_own") == F.col("_k")), "left")
    return joined.select(path, F.when(F.col("pdf").isNotNull(), "ok").otherwise("no-readable-pdf").alias("status"), "pdf")


def migration_plan(files: DataFrame, target: Column, folder: str = "folder", path: str = "path") -> DataFrame:
    """(folder, path, target, action): a folder moves whole or, if two files want one place or a place is taken, not."""
    planned = files.withColumn("target", target)
    wanted = planned.where("target IS NOT NULL").groupBy(folder, "target").agg(F.count("*").alias("n"))
    taken = planned.select(F.col(folder).alias("_f"), F.col(path).alias("_p")).distinct()
    bad = wanted.join(taken, (F.col(folder) == F.col("_f")) & (F.col("target") == F.col("_p")), "left").where("n > 1 OR _p IS NOT NULL").select(F.col(folder).alias("_bad")).distinct()
    joined = planned.join(bad, F.col(folder) == F.col("_bad"), "left")
    action = F.when(F.col("_bad").isNotNull(), "skip").when(F.col("target").isNotNull(), "move").otherwise("keep")
    return joined.select(folder, path, "target", action.alias("action"))


def meaningful_changes(files: DataFrame, path: str = "path") -> DataFrame:
    """Changed files without self-maintenance; requirements.txt counts as such if synthesis code changed too."""
    code = files.agg(F.coalesce(F.max(F.col(path).startswith(SYNTHESIS)), F.lit(False)).alias("_code"))
    kept = files.where(~F.col(path).isin(MAINTENANCE)).crossJoin(F.broadcast(code))  # one row
    return kept.where((F.col(path) != "requirements.txt") | ~F.col("_code")).drop("_code")


def ready(files: DataFrame, folder: str = "folder", kind: str = "kind") -> DataFrame:
    """(folder, ready): archived, with original output, one final PDF and the posting, and no earlier report."""
    n = lambda k: F.sum((F.col(kind) == k).cast("int"))
    good = (n("archived") > 0) & (n("output") > 0) & (n("final-pdf") == 1) & (n("posting") > 0) & (n("report") == 0)
    return files.groupBy(folder).agg(good.alias("ready"))


def listing_page(apply_url, job_id) -> Column:
    """An application address that only carries the posting's number in its query, on a path that lists postings."""
    u, n = strip(apply_url), F.coalesce(col(job_id).cast("string"), F.lit(""))
    path, query = F.lower(F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)), F.regexp_extract(u, r"\?([^#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return (n != "") & ~F.contains(path, n) & F.contains(query, n) & F.array_contains(strings(LISTINGS), last)


def greenhouse_link(board, job_id) -> Column:
    return F.concat(F.lit("https://job-boards.greenhouse.io/"), F.nullif(strip(board), F.lit("")), F.lit("/jobs/"), F.nullif(strip(col(job_id).cast("string")), F.lit("")))


def mention_only(sentence, mention: str, specifics: str) -> Column:
    """A sentence that names a thing without saying anything of it."""
    return has(sentence, mention) & ~has(sentence, specifics)


def newest_version(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """(folder, path) of the highest final-vN in each folder."""
    v = F.regexp_extract(path, r"final-v(\d+)", 1).try_cast("int")
    return files.where(v.isNotNull()).groupBy(folder).agg(F.max_by(path, v).alias("path"))
