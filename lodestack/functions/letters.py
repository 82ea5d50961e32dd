"""Lint of letters: rules as expressions over a Markdown text, each finding a level and a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import compacted
from .text import chain, col

# Bounds of links, words, rhythm, lists and shrinkage.
LINKS = (1, 5)
WORDS = (240, 650)
FLAT, TRIADS, SHRUNK, SMOOTHED = 0.35, 6, 0.85, 0.8
UNCONTRACTED = ["do not", "does not", "did not", "is not", "are not", "was not", "can not", "cannot", "will not", "it is", "that is", "I am", "I have", "I would", "I will", "you are", "we are"]
LINK = r"\[([^\]]+)\]\(([^)\s]+)\)"


def prose(text) -> Column:
    """Text without link targets and addresses."""
    return chain(F.coalesce(col(text), F.lit("")), (LINK, "$1"), (r"https?://\S+", " "))


def body(text, signature: str | None = None) -> Column:
    """Prose without reference, date, salutation and signature lines."""
    drop = r"(?i)^\s*(re:|dear |sincerely|warmly|best,|looking forward)|^\s*\w+day, \w+ \d{1,2}, \d{4}\s*$|^\s*\w{3}, \w+ \d{1,2}, \d{4}\s*$"
    kept = F.filter(F.split(prose(text), "\n"), lambda x: ~x.rlike(drop) & (F.lower(F.trim(x)) != (signature or "\u0000").lower()))
    return F.array_join(kept, "\n")


def count(c, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col(c), F.lit(f"({pattern})")))


def variation(text: Column) -> Column:
    """Deviation over mean of the words of sentences of three or more, from eight sentences on."""
    parts = F.split(F.regexp_replace(text, r"(?<=[.!?])\s+", "\u0001"), "\u0001")
    n = F.filter(F.transform(parts, lambda p: F.size(F.regexp_extract_all(p, F.lit(r"([A-Za-z'\-]+)")))), lambda x: x >= 3)
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / F.size(n)
    return F.when(F.size(n) >= 8, F.sqrt(F.greatest(square / F.size(n) - mean * mean, F.lit(0.0))) / mean)


def findings(text, previous=None, banned: dict[str, str] | None = None, disabled: list[str] | None = None, signature: str | None = None) -> Column:
    """`level:rule` for every rule that a letter breaks, in order; with an earlier version also what a revision lost.

    banned: patterns to levels. disabled: rules left out."""
    raw, p, b = F.coalesce(col(text), F.lit("")), prose(text), body(text, signature)
    links, words, cv = count(raw, r"\[[^\]]+\]\([^)\s]+\)"), count(b, r"[A-Za-z'\-]+"), variation(b)
    loose = sum((F.size(F.regexp_extract_all(p, F.lit(rf"(?i)(\b{u}\b)"))) for u in UNCONTRACTED[1:]), F.size(F.regexp_extract_all(p, F.lit(rf"(?i)(\b{UNCONTRACTED[0]}\b)"))))
    triads = count(p, r"(?:[^,.!?;:\n]+,\s+){2}and\s+[^,.!?\n]+")
    cheers = count(p, "!")
    rules = [(raw.rlike("[—–]"), "error:em-dash"), (F.contains(p, F.lit(";")), "error:semicolon")]
    rules += [(p.rlike("(?i)" + pattern), f"{level}:phrase") for pattern, level in (banned or {}).items()]
    rules += [
        (loose == 1, "warn:contraction"), (loose > 1, "error:contraction"), (triads >= TRIADS, "warn:triads"), ((links < LINKS[0]) | (links > LINKS[1]), "error:links"),
        (raw.rlike(r"(?i)\[\s*(here|this|read more|link)\s*\]\("), "error:link-anchor"), ((cheers == 0) | (cheers > 3), "warn:energy"), (cv < FLAT, "warn:rhythm"),
        ((words > WORDS[1]) | (words < WORDS[0]), "warn:length"),
    ]
    if previous is not None:
        old = F.coalesce(col(previous), F.lit(""))
        urls = lambda c: F.regexp_extract_all(c, F.lit(LINK), F.lit(2))
        old_body = body(previous, signature)
        rules += [
            (cheers < count(prose(previous), "!"), "error:smoothing"), (F.size(F.array_except(urls(old), urls(raw))) > 0, "error:smoothing-links"),
            (cv < variation(old_body) * SMOOTHED, "warn:smoothing-rhythm"), (words < count(old_body, r"[A-Za-z'\-]+") * SHRUNK, "warn:smoothing-length"),
        ]
    return compacted(*[(c, m) for c, m in rules if m.split(":")[1] not in (disabled or [])])
