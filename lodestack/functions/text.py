"""Text expressions. Patterns are Java's; white space and letters are ASCII unless a pattern says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Letters whose capital is written as several, each with its one-letter capital; those without one stand for themselves.
CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0xDF, 0xFB18)) if not "\ud800" <= c <= "\udfff" and len(c.upper()) > 1}


def upper_letter(c) -> Column:
    """A letter's capital as one letter: ß to ẞ, where upper() writes SS."""
    return F.coalesce(lookup(c, CAPITALS), F.upper(col(c)))


def strip(c, chars: str = r"\s") -> Column:
    """Without leading and trailing characters of a class; null is empty."""
    if chars == r"\s":
        return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), f"^[{chars}]+|[{chars}]+$", "")


def squash(c) -> Column:
    """White space runs as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def blank(c) -> Column:
    return strip(c) == ""


def bound(value: Column, use) -> Column:
    """use(value) with value computed once. An expression that is named twice is computed twice, and one that is built
    of such ones as often as their product; so what is costly and used again is bound."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c) -> Column:
    """A text, null where it is empty."""
    return F.get(F.filter(F.array(col(c)), lambda x: x != ""), F.lit(0))


def first(c, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return filled(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, group))


def has(c, pattern: str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(pattern)


def chain(c, *steps: tuple[str, str]) -> Column:
    """Replacements, one after the other."""
    out = col(c)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def wording(phrases, gap: str = r"[-\s]+") -> str:
    """A pattern of plain phrases, the longest first; where one has a blank, a text may have gap."""
    return "(?:" + "|".join(gap.join(re.escape(w) for w in p.split(" ")) for p in sorted(phrases, key=len, reverse=True)) + ")"


def lookup(c, table: dict[str, str]) -> Column:
    """The value of a key in a fixed table, else null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return pairs[col(c)]


def hits(c, phrases) -> Column:
    """How many of the phrases a text contains."""
    found = F.lit(0)
    for p in phrases:
        found = found + F.contains(col(c), F.lit(p)).cast("int")
    return found


def slug(c, limit: int = 80) -> Column:
    """Lower-case letters and digits with single dashes between; `job` where none is left."""
    plain = chain(strip(c), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "))
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(made == "", "job").otherwise(made)


def first_line(title) -> Column:
    """A title up to its first bar or spaced dash."""
    return strip(F.element_at(F.split(F.element_at(F.split(F.coalesce(col(title), F.lit("")), r"\|"), 1), " - "), 1))


def identity_key(c) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def prettify_slug(c) -> Column:
    """Dashes to blanks; words without a leading capital are capitalised, others stay."""

    def pretty(raw: Column) -> Column:
        words = F.filter(F.split(F.trim(F.regexp_replace(raw, "[-_]+", " ")), r"\s+"), lambda w: w != "")
        made = F.array_join(F.transform(words, lambda w: F.when(F.substring(w, 1, 1).rlike("[A-Z]"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")
        return bound(made, lambda m: F.when(m == "", raw).otherwise(m))

    return bound(col(c), pretty)


def strip_wrapping_quotes(c) -> Column:
    return strip(strip(strip(c), "\"“”„‟"))


def smarten(c) -> Column:
    """Straight quotes to curly ones by what stands before them."""
    return chain(c, (r'(^|[\s(\[{—–-])"', "$1“"), ('"', "”"), (r"(^|[\s(\[{—–-])'", "$1‘"), ("'", "’"))


def oxford_join(items) -> Column:
    """a; a and b; a, b, and c."""
    a, n = col(items), F.size(items)
    return (
        F.when(n == 0, "").when(n == 1, F.element_at(a, 1)).when(n == 2, F.concat_ws(" and ", a))
        .otherwise(F.concat(F.array_join(F.slice(a, 1, n - 1), ", "), F.lit(", and "), F.element_at(a, -1)))
    )


def repair_fusion(c) -> Column:
    """`orNew` to `or New`; what stands before is no ASCII letter, digit or underscore."""
    return F.regexp_replace(col(c), r"(?<![A-Za-z0-9_])(or|and|of)(?=[A-Z][a-z])", "$1 ")


def title_tokens(c, stop) -> Column:
    """Distinct words of three or more letters and digits that say something about a role."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(strings(stop), w)))


#: How a page becomes text, step by step; the patterns are also valid where there is no look-around.
HTML_STEPS = [
    (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>|</?(?:p|div|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|title|body|head|html)\b[^>]*>|</li>", "\n"),
    (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"),
]


def strip_html(c) -> Column:
    """Text of a page: scripts, styles, comments and tags go, blocks and breaks end lines, entities are read."""
    return strip(chain(F.coalesce(col(c), F.lit("")), *HTML_STEPS))


def bullet_key(c) -> Column:
    """A bullet without emphasis, links and punctuation, in lower case: what copies of it share."""
    return strip(chain(F.lower(col(c)), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]", ""), (r"[^a-z0-9 ]", " "), (r"\s+", " ")))


def sentences(c) -> Column:
    """Sentences: split behind full stops, question and exclamation marks before white space, and at line ends."""
    parts = F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([.!?])\s+", "$1\n"), "\n+")
    return F.filter(F.transform(parts, squash), lambda s: s != "")


def word_count(c) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\S+)")))
