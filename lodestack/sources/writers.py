"""Captures as text, manifests with counts, reports, and capture tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import capture_time
from ..functions.text import strip
from ..operators.captures import status_counts

BODY_START, BODY_END = "=== JOB POST START ===", "=== JOB POST END ==="
LABELS = [("Company", "company"), ("Role", "title"), ("Working Location(s)", "location"), ("Employment Type", "employment_type"), ("Base Salary", "compensation"), ("Posted", "posted_date"), ("Apply URL", "apply_url"), ("Job Posting URL", "url")]
ABSENT = "Employer did not mention"


def capture_text(captured_at: str = "fetched_at", body: str = "text") -> Column:
    """A capture: every label in its order, what is absent said so, and the body byte for byte between marks."""
    head = [F.concat(F.lit(f"{label}: "), F.when(strip(c) == "", ABSENT).otherwise(F.coalesce(F.col(c), F.lit(ABSENT)))) for label, c in LABELS]
    when = F.concat(F.lit("Captured: "), F.coalesce(capture_time(captured_at), F.lit("Time Unavailable")))
    return F.concat_ws("\n", *head, when, F.lit(""), F.lit(BODY_START), F.coalesce(F.col(body), F.lit("")), F.lit(BODY_END))


def stub_text(reason: str = "reason") -> Column:
    """A thin or failed capture: why, then the capture as far as it goes."""
    return F.concat_ws("\n", F.concat(F.lit("QUARANTINED: "), F.coalesce(F.col(reason), F.lit("unknown"))), capture_text())


def body_of(text: Column) -> Column:
    """The body between a capture's marks."""
    return F.substring_index(F.substring_index(text, f"{BODY_START}\n", -1), f"\n{BODY_END}", 1)


def write_captures(rows: DataFrame, path: str) -> None:
    """rows with status and filename as Parquet by status: usable ones as captures, others as stubs."""
    made = F.when(F.col("status") == "usable", capture_text()).otherwise(stub_text())
    rows.select("status", "filename", made.alias("text")).write.mode("overwrite").partitionBy("status").parquet(path)


def write_manifest(entries: DataFrame, path: str) -> DataFrame:
    """Entries as JSON lines to a new path; gives the counts by status, zeros included."""
    entries.write.mode("overwrite").json(path)
    return status_counts(entries)


def report(entries: DataFrame) -> DataFrame:
    """(status, n, lines): a report's groups, lines in the order of pos."""
    line = F.concat(F.lit("- "), F.coalesce("company", F.lit("Unknown")), F.lit(": "), F.coalesce("title", F.lit("Unknown Title")))
    groups = entries.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return groups.select("status", "n", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def with_history(captures: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """captures whose text behind the body is the history of their key anew; changed says where it differs."""
    own = history.select(F.col(key).alias("_k"), F.col("history").alias("_h"))
    joined = captures.join(own, F.col(key) == F.col("_k"), "left")
    base = F.concat(F.substring_index("text", BODY_END, 1), F.lit(BODY_END))
    new = F.when(F.col("_h").isNotNull(), F.concat_ws("\n", base, F.lit("Capture History:"), F.col("_h"))).otherwise(F.col("text"))
    return joined.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col("text"))).withColumn("text", F.col("_new")).drop("_k", "_h", "_new")
