"""Revisions of texts: shortest edits between versions, pages of submissions, exempted phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff
from ..operators import writing
from .registry import literal, query, read

# a version of each text: of seven lines in turn one goes, one is marked, one stands twice, one goes to the end, by place and id
REVISED = """flatten(transform(ls, (l, i) -> CASE (doc_id + 5 * i) % 7 WHEN 0 THEN array() WHEN 1 THEN array(concat(l, ' (revised)')) WHEN 2 THEN array(l, l) WHEN 3 THEN array() ELSE array(l) END))"""
MOVED = """filter(ls, (l, i) -> (doc_id + 5 * i) % 7 = 3)"""


@query("""
WITH o AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
v AS (SELECT doc_id, ls, flatten(list_transform(ls, lambda l, i: CASE (doc_id + 5 * (i - 1)) % 7 WHEN 0 THEN [] WHEN 1 THEN [l || ' (revised)'] WHEN 2 THEN [l, l] WHEN 3 THEN [] ELSE [l] END))
             || list_filter(ls, lambda l, i: (doc_id + 5 * (i - 1)) % 7 = 3) AS vs FROM o)
SELECT doc_id, len(ls)::INT AS old_lines, len(vs)::INT AS new_lines, md5(array_to_string(vs, chr(10))) AS new_md5, md5(array_to_string(ls, chr(10))) AS old_md5,
       (len(vs) - len(ls))::INT AS grown FROM v
""")
def revision_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN36: shortest edits from every document to a revised version, and what applying them gives."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    both = diff.with_script(rows.select("doc_id", "ls", F.concat(F.expr(REVISED), F.expr(MOVED)).alias("vs")), "ls", "vs")
    changed, back = diff.changes("script"), diff.applied("ls", "script")
    kept = F.aggregate(F.transform("script", lambda s: s["kept"]), F.lit(0), lambda n, x: n + x)
    return both.select("doc_id", (kept + changed["dropped"]).alias("old_lines"), (kept + changed["added"]).alias("new_lines"), F.md5(F.array_join(back, "\n")).alias("new_md5"), F.md5(F.array_join("ls", "\n")).alias("old_md5"), (changed["added"] - changed["dropped"]).alias("grown"))


PAGE = """CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN concat('Dear team,', chr(10), t, chr(10), 'Sincerely,', chr(10), 'A. B.') WHEN 1 THEN concat('Re: the role', chr(10), t, chr(10), 'Warmly,', chr(10), 'A. B.')
 WHEN 2 THEN concat('What would you bring to this team?', chr(10), t, chr(10), 'Why do you want to join us now?  ', chr(10), t) WHEN 3 THEN concat('Summary and Skills', chr(10), t, chr(10), 'Which of these did you lead?')
 WHEN 4 THEN concat('Application for the role', chr(10), 'How did you hear about us?', chr(10), t) ELSE t END"""
CLASS = """
  CASE WHEN (contains(head, 'dear ') AND (closes OR contains(head, 're:'))) OR (matter AND closes) THEN 'coverletter'
       WHEN asked >= 2 OR (asked >= 1 AND contains(head, 'application for')) THEN 'answers'
       WHEN headings >= 2 THEN 'resume' WHEN asked = 1 AND words > 80 THEN 'answers' ELSE 'resume' END"""
SOME = " OR ".join(f"contains(tail, {literal(w)})" for w in writing.CLOSINGS)
HEADINGS = " + ".join(f"contains(low, {literal(w)})::INT" for w in writing.RESUME_WORDS)


@query(f"""
WITH p AS (SELECT conv_id, turn, {PAGE} AS p FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)),
q AS (SELECT conv_id, turn, lower(p) AS low, lower(p)[1:500] AS head, right(lower(p), 600) AS tail, len(regexp_extract_all(p, '[^ \\t-\\r]+')) AS words,
        len(list_filter(list_transform(string_split(p, chr(10)), lambda x: rtrim(replace(x, chr(13), ''), ' ')), lambda x: length(x) BETWEEN 16 AND 141 AND strpos(x, '?') = length(x))) AS asked FROM p),
r AS (SELECT *, ({SOME}) AS closes, len(list_filter(string_split(head, chr(10)), lambda x: starts_with(x, 're:'))) > 0 AS matter, {HEADINGS} AS headings FROM q),
c AS (SELECT conv_id, turn, {CLASS} AS kind FROM r),
n AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY conv_id ORDER BY turn, kind) IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, kind ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT conv_id, kind, run, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n_pages FROM i GROUP BY ALL)
SELECT conv_id, kind, first, last, n_pages, row_number() OVER (PARTITION BY conv_id, kind ORDER BY n_pages DESC, first) = 1 AS chosen FROM g
""")
def submission_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN36, AGG13: classes of the turns of every conversation, dressed as pages of six kinds, in runs of one class."""
    pages = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    return writing.page_runs(pages.select("conv_id", "turn", writing.page_class(F.expr(PAGE)).alias("kind")), "conv_id", "turn", "kind")


# phrases that rules forbid, and wordings in which they may stand: at the first place only, or at all
FORBIDDEN = ["the", "of", "and", "que", "der"]
ALLOWED = [("of the", False), ("the of", True), ("and the of the", True), ("the and", False), ("que la", True), ("der d", True)]


def _positions(phrase: str) -> str:
    """SQL for the places of a phrase in lower(text), as a list."""
    gaps = f"string_split(lower(text), {literal(phrase)})"
    return f"list_transform(range(1, len({gaps})), lambda i: (list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + (i - 1) * {len(phrase)})::BIGINT)"


def _each(phrases: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, {len(p)} AS n, {_positions(p)} AS pl FROM documents WHERE contains(lower(text), {literal(p)})" for i, p in enumerate(phrases))


@query(f"""
WITH h AS (SELECT doc_id, rule, unnest(pl) AS start, unnest(pl) + n AS stop FROM ({_each(FORBIDDEN)})),
f AS (SELECT doc_id, CASE WHEN rule IN ({", ".join(str(i) for i, (_, every) in enumerate(ALLOWED) if every)}) THEN pl ELSE pl[1:1] END AS pl, n FROM ({_each([p for p, _ in ALLOWED])})),
x AS (SELECT doc_id, unnest(pl) AS start, unnest(pl) + n AS stop FROM f),
k AS (SELECT h.*, EXISTS (SELECT 1 FROM x WHERE x.doc_id = h.doc_id AND x.start <= h.start AND h.stop <= x.stop) AS held FROM h)
SELECT doc_id, rule, count(*)::BIGINT AS n_left, min(start)::BIGINT AS first_at, sum(start)::BIGINT AS places FROM k WHERE NOT held GROUP BY ALL
""")
def lint_unexempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34: hits of forbidden phrases in every document that no exempted wording holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    hits = writing.spans(docs, "doc_id", "text", [(str(i), p) for i, p in enumerate(FORBIDDEN)])
    left = writing.unexempted(hits, writing.exempt_spans(docs, "doc_id", "text", ALLOWED), "doc_id")
    return left.groupBy("doc_id", F.col("rule").cast("int").alias("rule")).agg(F.count("*").alias("n_left"), F.min("start").cast("long").alias("first_at"), F.sum("start").cast("long").alias("places"))
