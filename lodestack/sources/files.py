"""Lists, manifests, capture folders, tracker tables and Markdown sections as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first, strip

ENTRY = "original_url string, normalized_url string, status string, method string, company string, title string, fetched_at string, posting_id string, duplicate_of string"


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a list, trimmed, without blank ones and comments, in order."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value")).select("pos", strip("value").alias("value"))
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def manifests(spark: SparkSession, root: str, name: str = "prep-manifest.json") -> DataFrame:
    """Events of every manifest below a folder: dated entries that are no duplicates, with the manifest's path.

    A manifest that can't be read counts as empty."""
    schema = T.StructType([T.StructField("entries", T.ArrayType(T._parse_datatype_string(f"struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ENTRY.split(', '))}>")))])
    found = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name, mode="PERMISSIVE")
    entries = found.select(F.col("_metadata.file_path").alias("manifest"), F.explode("entries").alias("e")).select("manifest", "e.*")
    return entries.where(F.col("fetched_at").isNotNull() & (F.col("status") != "duplicate"))


def capture_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, text) of all captures below a folder."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def tracker_csv(spark: SparkSession, path: str, scores: list[str]) -> DataFrame:
    """A tracker table as text, headers trimmed, blank rows dropped, and a number beside each score column.

    A cell that is no whole number stays as text with a null number."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    rows = rows.toDF(*[c.strip() for c in rows.columns]).fillna("")
    filled = None
    for c in rows.columns:
        has = strip(F.col(f"`{c}`")) != ""
        filled = has if filled is None else filled | has
    rows = rows.where(filled)
    for c in scores:
        rows = rows.withColumn(f"{c}#", strip(F.col(f"`{c}`")).try_cast("int"))
    return rows


def sections(text: Column, level: int = 3) -> Column:
    """(title, body) of the headings of a level in a Markdown text, in order."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), rf"\n#{{{level}}}[ \t]+"), 2, 1_000_000)
    one = lambda p: F.struct(strip(F.element_at(F.split(p, "\n"), 1)).alias("title"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body"))
    return F.transform(parts, one)


def changelog(text: Column) -> Column:
    """Typed sections of a changelog: dated (m/d/yy or a span), pre-history, earlier or unknown, with sort keys."""
    day = lambda s: F.date_format(F.try_to_date(s, "M/d/yy"), "yyyy-MM-dd")

    def typed(s: Column) -> Column:
        t = s["title"]
        a, b = first(t, r"(\d{1,2}/\d{1,2}/\d{2})"), first(t, r"\d{1,2}/\d{1,2}/\d{2}\s*[-–—]\s*(\d{1,2}/\d{1,2}/\d{2})")
        kind = F.when(a.isNotNull(), "dated").when(F.lower(t).contains("pre-history"), "pre-history").when(F.lower(t).startswith("earlier"), "earlier").otherwise("unknown")
        return F.struct(t.alias("title"), s["body"].alias("body"), kind.alias("kind"), day(a).alias("start"), day(F.coalesce(b, a)).alias("end"))

    return F.transform(sections(text, 2), typed)


def sorted_changelog(rows: DataFrame) -> DataFrame:
    """(idx, title, body, kind, start, end) rows: dated by end and start, newest first, then pre-history, earlier and
    unknown, in the order they came."""
    rank = F.when(F.col("kind") == "dated", 0).when(F.col("kind") == "pre-history", 1).when(F.col("kind") == "earlier", 2).otherwise(3)
    return rows.orderBy(rank, F.desc("end"), F.desc("start"), "idx")


def processed_commit(text: Column) -> Column:
    return first(text, r"<!--\s*processed-commit:\s*([0-9a-f]{7,40})\s*-->")


def with_processed_commit(text: Column, commit: Column) -> Column:
    """The marker replaced, or put in front where there is none."""
    mark = F.concat(F.lit("<!-- processed-commit: "), commit, F.lit(" -->"))
    shape = r"<!--\s*processed-commit:\s*[0-9a-f]{7,40}\s*-->"
    return F.when(text.rlike(shape), F.regexp_replace(text, F.lit(shape), mark)).otherwise(F.concat(mark, F.lit("\n"), text))


def settings(user: dict | None, defaults: dict) -> dict:
    """Settings over defaults, table by table."""
    out = dict(defaults)
    for k, v in (user or {}).items():
        out[k] = settings(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def first_by_priority(files: DataFrame, places: list[str], folder: str = "folder", place: str = "place") -> DataFrame:
    """Of the files (folder, place, path) of each folder the first in the order of places, by path among equals."""
    rank = F.array_position(F.array(*[F.lit(p) for p in places]), F.col(place))
    ranked = files.withColumn("_r", rank).where("_r > 0")
    return ranked.groupBy(folder).agg(F.min_by("path", F.struct("_r", "path")).alias("path"))
