"""Dates of postings and captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, has, strip


def posting_date(value) -> Column:
    """A plain date of an ISO date or timestamp (its offset isn't applied) or of epoch seconds or milliseconds."""

    def dated(s: Column) -> Column:
        epoch = s.try_cast("double")
        seconds = F.when(epoch > 1e11, epoch / 1000).otherwise(epoch)
        from_epoch = F.when(epoch > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))
        iso = F.date_format(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
        return F.when(s.rlike(r"^\d{10,13}$"), from_epoch).when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)

    return bound(strip(value), dated)


def capture_date(raw) -> Column:
    """A date read back from a capture, written out or ISO; empty if neither."""
    s = strip(raw)
    long = F.date_format(F.try_to_date(s, "MMMM d, yyyy"), "yyyy-MM-dd")
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(s, "yyyy-MM-dd"), "yyyy-MM-dd")), F.when(s.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), long), F.lit(""))


def human_date(iso) -> Column:
    """June 13, 2026; what isn't a date stays as it is."""
    made = F.date_format(F.try_to_date(F.substring(strip(iso), 1, 10), "yyyy-MM-dd"), "MMMM d, yyyy")
    return F.coalesce(made, col(iso))


def capture_time(ts) -> Column:
    """A UTC time on the Eastern clock."""
    local = F.from_utc_timestamp(col(ts), "America/New_York")
    return F.concat(F.date_format(local, "MMMM d, yyyy"), F.lit(" at "), F.date_format(local, "h:mm a"), F.lit(" ET"))


def last_update(posted, updated) -> Column:
    """The later of two known dates' columns: updated if it says something, else posted, else Unknown."""
    known = [F.when((strip(c) != "") & (strip(c) != "Unknown"), strip(c)) for c in (updated, posted)]
    return F.coalesce(*known, F.lit("Unknown"))


def recency(day, as_of) -> Column:
    """fresh to 7 days, recent to 30, aging to 60, then stale; null without a date or in the future."""
    age = F.datediff(F.lit(as_of).cast("date"), col(day).cast("date"))
    return F.when(age < 0, None).when(age <= 7, "fresh").when(age <= 30, "recent").when(age <= 60, "aging").when(age.isNotNull(), "stale")


def batch_name(c) -> Column:
    """Whether a batch is named MM-DD-YY."""
    return has(c, r"^\d{2}-\d{2}-\d{2}$")
