"""Captures by the names that rows give: fixed places in their order, then a search below the row's own folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _below(folder: Column, name: Column) -> Column:
    """name in folder; an absolute name stays."""
    return F.when(name.startswith("/"), name).when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def locate(rows: DataFrame, listing: DataFrame, key: str, name: str = "name", base: str = "base", source: Sequence[str] = ("sources", "captures")) -> DataFrame:
    """(key, path, rank): for each row of rows with a capture the first place that has one.

    Places in their order: name as given (0), in base (1), in base's parent (2), its last part in the parent's source
    folder (3), anywhere below base (4), anywhere below the parent (5) if that holds the first folder of source, which
    marks a batch's root, so that no other batch's capture is found. Of several hits of a search the one in the fewest
    folders is taken, then the least path by code point. listing has a column path, parts parted by one slash;
    repeated paths count once. key must be unique in rows; null or blank names have no capture, a null base leaves
    the name as given alone, and nothing is searched above a base of one part. '.' and '..' aren't resolved.

    A file answers for its path and for its last part in each folder above it, so every place is an equality and a
    path is written once a folder of its depth. One join and one grouping, no comparison of parts of texts. Both sides
    are dealt out: what is exploded is judged by its size before, so the index would be sent whole through the driver."""
    path = F.col("path")
    files = listing.select("path").where("path IS NOT NULL").distinct()
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>"))
    last = F.element_at(parts, -1)
    hit = lambda kind, at, what: F.struct(F.lit(kind).alias("kind"), at.alias("at"), what.alias("what"))
    found = F.concat(
        F.array(hit("file", path, F.lit(""))), F.transform(folders, lambda f: hit("below", f, last)), F.transform(folders, lambda f: hit("folder", f, F.lit("")))
    )
    index = files.select(F.size(parts).alias("depth"), path, F.explode(found).alias("h")).groupBy("h.kind", "h.at", "h.what").agg(F.min(F.struct("depth", "path"))["path"].alias("path"))

    given, own = F.trim(F.col(name)), F.col(base)
    above = _parent(own)
    short = F.element_at(F.split(given, "/"), -1)
    probes = [("file", given, F.lit("")), ("file", _below(own, given), F.lit("")), ("file", _below(above, given), F.lit("")), ("file", _below(above, F.concat_ws("/", *map(F.lit, source), short)), F.lit("")),
              ("below", own, short), ("below", F.nullif(above, F.lit("")), short), ("folder", _below(above, F.lit(source[0])), F.lit(""))]
    asked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.when(F.lit(i == 0) | own.isNotNull(), a).alias("at"), w.alias("what")) for i, (k, a, w) in enumerate(probes)])
    tried = rows.where(given != "").select(F.col(key), F.explode(asked).alias("p")).select(key, "p.*")
    met = tried.join(index.hint("merge"), ["kind", "at", "what"]).groupBy(key).agg(
        F.min(F.when(F.col("rank") < 5, F.struct("rank", "path"))).alias("near"), F.min(F.when(F.col("rank") == 5, F.struct("rank", "path"))).alias("far"), F.max(F.col("rank") == 6).alias("root")
    )
    best = F.coalesce("near", F.when(F.col("root"), F.col("far")))
    return met.select(key, best["path"].alias("path"), best["rank"].alias("rank")).where("path IS NOT NULL")
