"""Roles out of what pages say they are, by how often a host's pages say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings

#: Pages of a host from which its habits can be told; a part that more than half of them share is the site's.
ENOUGH = 3
# Parts of titles that name no role.
CHROME = ["careers", "career", "jobs", "job", "home", "apply", "job openings", "open positions", "open roles", "join us", "work with us", "menu", "search"]
PREFIXES = ["careers at ", "jobs at ", "working at ", "work at ", "join "]
PARTED = r"\s+[|·•–—-]\s+|\s*[|·•]\s*"


def parts(text: Column) -> Column:
    """The parts of a title between bars, dots and free-standing dashes."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), PARTED), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def chrome(part: Column) -> Column:
    low = F.lower(part)
    return F.array_contains(strings(CHROME), low) | F.exists(strings(PREFIXES), lambda p: low.startswith(p))


def recover_roles(evidence: DataFrame, key: str) -> DataFrame:
    """(key, role, rank): of each page's evidence the first that still names something without the site's parts.

    evidence has key, host, rank (titles of structured data before those of markup, headings and lines of text) and
    text, any number of rows a page. A part that more than half of a host's pages share, from ENOUGH pages on, is the
    site's (its name, its suffix, a heading on every page); parts of navigation go too, and what is left of a text is
    its role. Pages of which nothing is left have no row: no role is invented. Null hosts are one host, null keys and
    texts no evidence.

    Parts are counted by host and text with partial sums; only parts that enough pages share meet their host's size,
    a handful a host, and what pages say is parted from them by an anti-join on host and part."""
    said = evidence.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.coalesce("host", F.lit("")).alias("host"), "rank", F.posexplode(parts(F.col("text"))).alias("_at", "_part"))
    said = said.where(~chrome(F.col("_part"))).withColumn("_low", F.lower("_part"))
    common = said.groupBy("host", "_low").agg(F.count_distinct(key).alias("_n")).where(F.col("_n") >= ENOUGH)
    pages = evidence.where(F.col(key).isNotNull()).select(F.coalesce("host", F.lit("")).alias("host"), key).groupBy("host").agg(F.count_distinct(key).alias("_pages"))
    sites = common.join(pages, "host").where(2 * F.col("_n") > F.col("_pages")).select("host", "_low")
    own = said.join(sites, ["host", "_low"], "left_anti")
    texts = own.groupBy(key, "rank").agg(F.array_sort(F.collect_set(F.struct("_at", "_part"))).alias("p"))
    best = texts.groupBy(key).agg(F.min(F.struct("rank", "p")).alias("b"))
    return best.select(key, F.array_join(F.transform("b.p", lambda x: x["_part"]), " - ").alias("role"), "b.rank")
