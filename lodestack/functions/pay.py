"""Pay in whole thousands: ranges, envelopes over all annual bands, fit labels and disagreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chain, col, first, has, squash

#: Plausible thousands.
LEAST, MOST = 10, 2000
AMOUNT = r"\$?\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*([KkMm])?"
PERIOD = r"(?:\s*(?:/\s*(?:yr|year|hr|hour|mo|month|wk|week)|per\s+(?:year|hour|month|week)|annually|hourly|monthly|weekly)\b)?"
BAND = rf"(?i){AMOUNT}{PERIOD}\s*(?:-|–|—|to|through)\s*{AMOUNT}{PERIOD}"
SINGLE = r"\$\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*([Kk])?"
NOT_ANNUAL = r"(?i)/\s*(?:hour|hr|mo|month|wk|week)\b|per\s+(?:hour|month|week)\b|hourly|monthly|weekly"
EXACT = "decimal(18,6)"


def normalize_range(text) -> Column:
    """`lo-hi`, or `??`: one figure stands for both ends, reversed ends are swapped, halves go to the even number."""
    t = squash(text)
    s = chain(t, (r"[,$]", ""), ("[–—]", "-"), (r"(?i)\bto\b", "-"))
    found = F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?\s*[kK]?)"))

    def thousands(x: Column) -> Column:
        v = F.regexp_extract(x, r"^([\d.]+)", 1).try_cast("double")
        return F.bround(F.when(~x.rlike("[kK]") & (v >= 10000), v / 1000).otherwise(v)).cast("long")

    n = F.transform(found, thousands)
    lo, hi = F.array_min(n), F.array_max(n)
    fine = F.size(n).isin(1, 2) & lo.between(LEAST, MOST) & hi.between(LEAST, MOST)
    nothing = (t == "") | F.contains(t, F.lit("?")) | F.lower(t).isin("unknown", "n/a", "na", "none", "not posted", "tbd")
    return F.when(nothing, "??").when(t.rlike(r"^\d+-\d+$"), t).when(fine, F.concat_ws("-", lo.cast("string"), hi.cast("string"))).otherwise("??")


def fit_label(pay, floor: int | None, target: int | None, top: int | None = None) -> Column:
    """How a range stands to floor, target and top of market: the top by its high end, the target by its middle."""
    shape = r"^\s*(\d+)-(\d+)\s*$"
    lo, hi = first(pay, shape).cast("long"), first(pay, shape, 2).cast("long")
    out = F.when(lo.isNull(), "Unknown")
    if floor is None and target is None:
        return out.otherwise("No comp prefs")
    if floor is not None:
        out = out.when(hi < floor, "Below floor")
    if top is not None:
        out = out.when(hi > top, "Top of market")
    return out.otherwise("Above floor") if target is None else out.when((lo + hi) / 2 >= target, "Meets/above target").otherwise("Near target")


def _thousands(raw: Column, scaled: Column) -> Column:
    v = F.regexp_replace(raw, ",", "").try_cast(EXACT)
    return F.when(scaled | (v < 1000), v).otherwise((v / 1000).cast(EXACT))


def bands(text) -> Column:
    """(lo, hi) of every annual band: ranges of each part of a text, or its first dollar figure where it has none."""

    def of(part: Column) -> Column:
        def band(whole: Column) -> Column:
            g = [F.regexp_extract(whole, rf"{BAND}", i) for i in range(1, 5)]
            scaled = (g[1] != "") | (g[3] != "")
            return F.struct(_thousands(g[0], scaled).alias("lo"), _thousands(g[2], scaled).alias("hi"))

        wholes = F.regexp_extract_all(part, F.lit(BAND), F.lit(0))
        ranges = F.filter(F.transform(wholes, band), lambda b: (b["lo"] <= b["hi"]) & b["lo"].between(LEAST, MOST))
        v = _thousands(F.regexp_extract(part, SINGLE, 1), F.regexp_extract(part, SINGLE, 2) != "")
        one = F.filter(F.array(F.struct(v.alias("lo"), v.alias("hi"))), lambda b: b["lo"].between(LEAST, MOST))
        single = F.when(has(part, SINGLE), one).otherwise(F.filter(one, lambda b: F.lit(False)))
        return F.when(has(part, NOT_ANNUAL), F.filter(ranges, lambda b: F.lit(False))).when(F.size(ranges) > 0, ranges).otherwise(single)

    parts = F.split(F.coalesce(col(text), F.lit("")), r"\s*[·;]\s*|\bvs\b")
    return F.flatten(F.transform(parts, lambda p: of(p)))


def envelope(text) -> Column:
    """Least low and greatest high end of all annual bands, each then rounded half up; empty without a band."""
    found = bands(text)
    lo = F.array_min(F.transform(found, lambda b: b["lo"]))
    hi = F.array_max(F.transform(found, lambda b: b["hi"]))
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    return F.when(F.size(found) > 0, F.concat_ws("-", whole(lo), whole(hi))).otherwise("")


def figures(text) -> Column:
    """All plausible figures of a text in thousands."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?\s*[kK]|\d{2,3}(?=\s*[-–—]))"))
    sized = F.transform(found, lambda x: _thousands(F.regexp_extract(x, r"^([\d.,]+)", 1), x.rlike("[kK]")))
    return F.filter(sized, lambda v: v.between(LEAST, MOST))


def pay_disagrees(structured, prose) -> Column:
    """The spans of both texts' figures don't touch; a text without a figure never disagrees."""
    a, b = figures(structured), figures(prose)
    apart = (F.array_max(a) < F.array_min(b)) | (F.array_max(b) < F.array_min(a))
    return (F.size(a) > 0) & (F.size(b) > 0) & F.coalesce(apart, F.lit(False))
