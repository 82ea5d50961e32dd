"""The tracker table: migration to the contract, rule checks, repairs and targeted updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.dates import last_update
from ..functions.pay import normalize_range
from ..functions.places import normalize_location
from ..functions.scores import fallback_completeness, normalize_lane, normalize_status

POSTED, UPDATED, MERGED = "ATS First Posted Date", "ATS Last Updated Date", "Posting Last Update"


def migrate(rows: DataFrame, contract: list[str] | None = None, renames: dict[str, str] | None = None, dropped: list[str] | None = None) -> DataFrame:
    """rows under the contract: two legacy dates as one, renames, drops, blanks for what is missing, then the contract's
    order with other columns behind. Columns are found by name; running it again changes nothing."""
    contract = contract or vocab.CONTRACT
    if POSTED in rows.columns or UPDATED in rows.columns:
        date = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit("")
        rows = rows.withColumn(MERGED, last_update(date(POSTED), date(UPDATED))).drop(POSTED, UPDATED)
    rows = rows.withColumnsRenamed({a: b for a, b in (renames or {}).items() if a in rows.columns and b not in rows.columns}).drop(*(dropped or []))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in contract]
    return rows.select(*cells, *[F.col(f"`{c}`") for c in rows.columns if c not in contract])


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, with all its columns and rule."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.withColumn("rule", F.explode(broken))


def repairs(place: dict | None = None) -> dict[str, Column]:
    """What each governed column must read."""
    c = lambda n: F.col(f"`{n}`")
    return {
        "Status? [You Change]": normalize_status(c("Status? [You Change]")), "Lane": normalize_lane(c("Lane")),
        "Working Location": normalize_location(c("Working Location"), place), "Comp Range": normalize_range(c("Comp Range")),
        "Posting Last Update": F.when(F.coalesce(c("Posting Last Update"), F.lit("")) == "", "Unknown").otherwise(c("Posting Last Update")),
    }


def normalize(rows: DataFrame, place: dict | None = None) -> DataFrame:
    """rows with all governed cells repaired, and repaired: how many of a row's cells changed. A second pass changes
    none."""
    fixes = {k: v for k, v in repairs(place).items() if k in rows.columns}
    changed = sum(((~F.col(f"`{k}`").eqNullSafe(v)).cast("int") for k, v in fixes.items()), F.lit(0))
    out = rows.withColumn("repaired", changed)
    for k, v in fixes.items():
        out = out.withColumn(k, v)
    if "Data Completeness" in rows.columns:
        own = F.col("`Data Completeness`")
        out = out.withColumn("Data Completeness", F.when(F.coalesce(own, F.lit("")) == "", fallback_completeness(F.col("`Comp Range`"), F.col("`Working Location`"))).otherwise(own))
    return out


def cell_changes(rows: DataFrame, fixes: dict[str, Column], key: list[str]) -> DataFrame:
    """(key…, column, old, new): a row for each cell of rows that fixes change, as text; nothing is shuffled."""
    cells = [F.when(~F.col(f"`{c}`").eqNullSafe(v), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("old"), v.cast("string").alias("new"))) for c, v in fixes.items() if c in rows.columns]
    none = F.array().cast("array<struct<column:string,old:string,new:string>>")
    return rows.select(*key, F.explode(F.array_compact(F.array(*cells)) if cells else none).alias("c")).select(*key, "c.*")


def rewrite_changed(spark: SparkSession, path: str, part: str, fixes: dict[str, Column]) -> int:
    """Puts fixes into the table at path, which is partitioned by the column part; gives the number of cells changed.

    Only partitions that hold a changed cell are written again, from all their rows; without one no file is touched.
    The new rows are written beside the table and take the old ones' place when all tasks are done, so a lost executor
    costs its tasks alone. fixes can't change part itself. Rows with a null part are a partition as well."""
    if part in fixes:
        raise ValueError("a cell that names its row's partition can't be rewritten in place")
    rows = spark.read.parquet(path)
    counts = cell_changes(rows, fixes, [part]).groupBy(part).agg(F.count("*").alias("n"))
    touched = {r[part]: r["n"] for r in counts.collect()}  # a row a partition, as many as folders
    if not touched:
        return 0
    named = F.col(part).isin([v for v in touched if v is not None])
    here = F.coalesce(named, F.lit(False)) | F.col(part).isNull() if None in touched else named
    fixed = rows.where(here).withColumns({c: v.cast(rows.schema[c].dataType) for c, v in fixes.items() if c in rows.columns})
    fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return sum(touched.values())


def update_rows(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows with the cells that updates give for their key; missing columns are made, null cells leave what stands."""
    names = [c for c in updates.columns if c != key]
    u = updates.select(F.col(f"`{key}`").alias("_k"), *[F.col(f"`{c}`").alias(f"_u{i}") for i, c in enumerate(names)])
    out = rows
    for c in names:
        if c not in rows.columns:
            out = out.withColumn(c, F.lit(""))
    joined = out.join(u, F.col(f"`{key}`") == F.col("_k"), "left")
    for i, c in enumerate(names):
        joined = joined.withColumn(c, F.coalesce(F.col(f"_u{i}"), F.col(f"`{c}`")))
    return joined.drop("_k", *[f"_u{i}" for i in range(len(names))])


def attention(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(category, n, names): rows by completeness category with their sorted different names."""
    from ..functions.scores import completeness_category

    return rows.groupBy(completeness_category(label).alias("category")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(key)), "; ").alias("names"))
