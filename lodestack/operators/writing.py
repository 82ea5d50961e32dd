"""Checks of letters and other written texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chain, col, sentences, squash, word_count

#: Sentences from which a rhythm can be told, and the variation below which it is flat.
LEAST, FLAT = 8, 0.35
#: Rules that someone may write by hand; more are refused.
MOST_RULES = 2000
HITS = "array<struct<rule:string,phrase:string,n:bigint>>"


def rhythm(rows: DataFrame, key: str, text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_sentences, variation): standard deviation over mean of the sentences' words."""
    n = rows.select(key, F.explode(F.transform(sentences(text), word_count)).alias("n"))
    out = n.groupBy(key).agg(F.count("*").alias("n_sentences"), (F.stddev_pop("n") / F.avg("n")).alias("variation"))
    return out.where(F.col("n_sentences") >= least)


def phrase_hits(rows: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, rule, phrase, n) for every rule's phrase that a text has, in lower case.

    Rules are a small table that someone writes by hand; they are read once and become one expression over the texts,
    so texts are scanned once and no product of texts and rules is formed. Null and empty phrases are no rules; without
    any rule there are no rows."""
    listed = [(r["phrase"], r["rule"]) for r in rules.where("phrase <> ''").select("phrase", "rule").limit(MOST_RULES + 1).collect()]
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    low = F.lower(F.coalesce(col(text), F.lit("")))
    made = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(p).alias("phrase"), F.floor((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("long").alias("n")) for p, rule in listed]).cast(HITS)
    found = rows.select(key, F.explode(F.filter(made, lambda s: s["n"] > 0)).alias("h"))
    return found.select(key, "h.rule", "h.phrase", "h.n")


def page_kind(text) -> Column:
    """letter, questions or other."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.contains(low, F.lit("dear ")), "letter").when(F.size(F.regexp_extract_all(low, F.lit("([?])"))) >= 2, "questions").otherwise("other")


# Closings of letters, headings of resumes.
CLOSINGS = ["looking forward", "warmly,", "sincerely", "best,", "thank you for", "i'd love the chance"]
RESUME_WORDS = ["experience", "skills", "education", "summary", "professional"]


def question_lines(text: Column) -> Column:
    """Lines of 16 to 141 characters whose only question mark is their last one."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.replace(x, F.lit("\r"), F.lit(""))))
    return F.filter(trimmed, lambda x: (F.length(x).between(16, 141)) & (F.instr(x, "?") == F.length(x)))


def page_class(text) -> Column:
    """coverletter, answers or resume: what a page of a submitted application is.

    A letter greets or names its matter and closes; answers stand under questions; a long text under a single question
    is an answer unless it has a resume's headings. All else counts as resume, null and empty pages too."""
    whole = F.coalesce(col(text), F.lit(""))
    low = F.lower(whole)
    head, tail = F.substring(low, 1, 500), F.right(low, F.lit(600))
    some = lambda c, words: reduce(lambda x, y: x | y, [F.contains(c, F.lit(w)) for w in words])
    closes, asked = some(tail, CLOSINGS), F.size(question_lines(whole))
    matter = F.exists(F.split(head, "\n"), lambda x: F.startswith(x, F.lit("re:")))
    headings = reduce(lambda x, y: x + y, [F.contains(low, F.lit(w)).cast("int") for w in RESUME_WORDS])
    letter = F.contains(head, F.lit("dear ")) & (closes | F.contains(head, F.lit("re:"))) | (matter & closes)
    answers = (asked >= 2) | ((asked >= 1) & F.contains(head, F.lit("application for")))
    long = (asked == 1) & (F.size(F.regexp_extract_all(whole, F.lit(r"(\S+)"))) > 80)
    return F.when(letter, "coverletter").when(answers, "answers").when(headings >= 2, "resume").when(long, "answers").otherwise("resume")


def page_runs(pages: DataFrame, file: str, page: str, kind: str) -> DataFrame:
    """(file, kind, first, last, n_pages, chosen): pages of one class that follow each other in a file, as one run.

    chosen marks the longest run of its class in the file, the earlier of equals: the copy that is read where a file
    has the same letter twice. Repeated page numbers belong to one run. Windows are a file each; pages are few there."""
    by_page = Window.partitionBy(file).orderBy(page, kind)
    turned = F.when(F.lag(kind).over(by_page).eqNullSafe(F.col(kind)), 0).otherwise(1)
    runs = pages.select(file, page, kind, turned.alias("_new")).withColumn("_run", F.sum("_new").over(by_page))
    runs = runs.groupBy(file, "_run", kind).agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n_pages"))
    best = Window.partitionBy(file, kind).orderBy(F.desc("n_pages"), "first")
    return runs.select(file, kind, "first", "last", "n_pages", (F.row_number().over(best) == 1).alias("chosen"))


def diff_sentences(text, markdown: bool = False, contact: list[str] | None = None, signature: str | None = None) -> Column:
    """The sentences of two words or more that a comparison of submitted texts looks at.

    Short lines with an address, a profile or a phone number are letterhead; the signature goes too. Typographic
    quotes, dashes and ligatures, bullets, hyphens at line ends and blanks before marks are made alike. markdown
    also takes off links and stars."""
    out = F.coalesce(col(text), F.lit(""))
    if markdown:
        out = F.replace(F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1"), F.lit("*"), F.lit(""))
    marks = ["@", "linkedin.com", *(contact or [])]

    def letterhead(line: Column) -> Column:
        low = F.lower(line)
        named = reduce(lambda x, y: x | y, [F.contains(low, F.lit(m.lower())) for m in marks])
        return (named | low.rlike(r"\([0-9]{3}\)\s*[0-9]{3}")) & (F.length(F.trim(line)) < 140)

    lines = F.filter(F.split(out, r"\r?\n"), lambda x: ~letterhead(x) & (F.trim(x) != F.lit(signature or "\u0000")))
    out = F.array_join(lines, "\n")
    out = F.translate(out, "\u2019\u2018\u201c\u201d\u2013\u00a0", "''\"\"- ")
    for mark, plain in (("\u2014", ", "), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb00", "ff"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    out = chain(out, (r"[\u2022\u2023\u25aa]", " "), (r"(^|\n)[-*]\s+", "$1 "), (r"-\n(\w)", "$1"), (r"\s+([.,!?;:])", "$1"))
    cut = F.split(F.regexp_replace(squash(out), r"([.!?]) ", "$1\u0001"), "\u0001")
    return F.filter(cut, lambda s: F.size(F.filter(F.split(s, " "), lambda w: w != "")) >= 2)


def spans(rows: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, rule, nth, start, stop) of every match of (rule, pattern); case doesn't matter, positions are code points from 0.

    One scan of the texts for all patterns. Empty patterns are none; a pattern that matches nothing but empty text
    gives no spans."""
    whole = F.coalesce(col(text), F.lit(""))

    def of(pattern: str) -> Column:
        hits, gaps = F.regexp_extract_all(whole, F.lit(f"(?i)({pattern})"), F.lit(0)), F.split(whole, f"(?i)(?:{pattern})", -1)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            stop = start + F.length(pair["hit"])
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

        pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.aggregate(pairs, begin, step, lambda acc: acc["out"])

    made = [F.struct(F.lit(rule).alias("rule"), of(pattern).alias("spans")) for rule, pattern in patterns if pattern]
    if not made:
        return rows.select(key, F.lit("").alias("rule"), F.lit(0).alias("nth"), F.lit(0).alias("start"), F.lit(0).alias("stop")).where("1 = 0")
    each = rows.select(key, F.explode(F.array(*made)).alias("m"))
    return each.select(key, "m.rule", F.posexplode("m.spans").alias("nth", "s")).select(key, "rule", "nth", "s.start", "s.stop")


def unexempted(hits: DataFrame, exempt: DataFrame, key: str, width: int = 256) -> DataFrame:
    """hits that lie in no exempted span of their text: an anti-join by bins of positions.

    A span stands in each bin that it touches, a hit in the bin where it begins, so a hit meets those spans alone that
    may hold it, and keys with many hits are dealt out by bin. Overlapping and nested spans may all hold a hit."""
    held = exempt.select(F.col(key).alias("_k"), F.col("start").alias("_from"), F.col("stop").alias("_to"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("_bin"))
    binned = hits.withColumn("_own", F.floor(F.col("start") / width))
    inside = (F.col(key) == F.col("_k")) & (F.col("_own") == F.col("_bin")) & (F.col("_from") <= F.col("start")) & (F.col("stop") <= F.col("_to"))
    return binned.join(held, inside, "left_anti").drop("_own")


def exempt_spans(rows: DataFrame, key: str, text: str, exemptions: list[tuple[str, bool]]) -> DataFrame:
    """(key, start, stop) that exemptions (pattern, all of its matches or the first only) leave alone."""
    every = {f"{i}": all_of for i, (_, all_of) in enumerate(exemptions)}
    found = spans(rows, key, text, [(f"{i}", p) for i, (p, _) in enumerate(exemptions)])
    return found.where((F.col("nth") == 0) | F.col("rule").isin([r for r, all_of in every.items() if all_of])).select(key, "start", "stop")


def link_losses(old, new) -> Column:
    """Links that an older text had and a newer has not."""
    links = lambda c: F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(https?://[^\s)\]>]+)"))
    return F.array_except(links(old), links(new))


def missing_sections(text, required: list[str]) -> Column:
    """Required headings that a Markdown text lacks."""
    heads = F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$")), F.lower)
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(heads, F.lower(r)))
