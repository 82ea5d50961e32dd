"""Captures over pages and documents: identity, dedupe, classification, counts, carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import captures, identity
from .registry import case, query, read, values

TRACKED = ", ".join(f"'{t}'" for t in vocab.TRACKING)
#: Markers that occur in the documents: their licence lines, addresses and passages.
OWN_CONTENT = ["licens", "copyright", "@", " the ", " der ", " que ", " les "]
OWN_STRUCTURE = ["license", "copyright"]


def html_sql(column: str) -> str:
    """The steps of a page to its text in SQL."""
    out = f"coalesce({column}, '')"
    for pattern, to in T.HTML_STEPS:
        new = " || ".join("chr(10)" if x == "\n" else "'" + x.replace("'", "''") + "'" for x in ([to] if "\n" not in to else [p for p in ("\n", to.replace("\n", "")) if p]))
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', {new or chr(39) * 2}, 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def quoted(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query(rf"""
WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
             regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host,
             regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'),
                       lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({TRACKED}))) AS kept
      FROM p)
SELECT page_id, (CASE WHEN scheme = '' THEN 'https' ELSE scheme END) || '://' || host || (CASE WHEN path = '' THEN '/' ELSE path END)
       || (CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END) AS url_key
FROM q
""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ02: the key of every page's address."""
    return read(spark, sf_dir, "pages").select("page_id", identity.normalize_url("url").alias("url_key"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) > 1 AS is_duplicate,
       CASE WHEN row_number() OVER (PARTITION BY host ORDER BY page_id) > 1 THEN first_value(url) OVER (PARTITION BY host ORDER BY page_id) END AS duplicate_of
FROM p
""")
def url_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN01, WIN02: the first page of a host stays, later ones point at it."""
    pages = read(spark, sf_dir, "pages").withColumn("host", identity.host("url"))
    return captures.first_wins(pages, "host", "page_id", "url").select("page_id", "is_duplicate", "duplicate_of")


@query(rf"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '.'), lambda x: x <> '') AS l,
                  regexp_matches(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?i)/careers(/|$)') AS careers FROM pages),
q AS (SELECT *, CASE WHEN len(l) >= 3 AND list_contains({quoted(vocab.SECOND_LEVEL)}, l[-2]) THEN l[-3] ELSE l[-2] END AS label FROM p)
SELECT page_id, CASE WHEN len(l) >= 2 AND NOT list_contains({quoted(vocab.DOMAIN_CHROME)}, label)
                      AND NOT (list_contains({quoted(vocab.ATS_HOSTS + vocab.BOARD_HOSTS)}, label) AND NOT careers)
                THEN array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(label, '[-_]+', ' ', 'g'), '\s+'), lambda x: x <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS company
FROM q
""")
def host_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ06: the employer that a page's host names."""
    return read(spark, sf_dir, "pages").select("page_id", identity.company_from_domain("url").alias("company"))


@query(f"SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {html_sql('html')} AS t FROM pages)")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14: a page's text, its length and digest."""
    body = T.strip_html("html")
    return read(spark, sf_dir, "pages").select("page_id", F.length(body).alias("n_chars"), F.md5(body).alias("text_md5"))


def classify_sql(content: list[str], structure: list[str], least: int, quorum: int, table: str = "documents", key: str = "doc_id") -> str:
    c, s, sh = quoted(content), quoted(structure), quoted(vocab.SHELL)
    return rf"""
WITH d AS (SELECT {key}, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM {table}),
h AS (SELECT {key}, t, len(list_filter({c}, lambda m: contains(lower(t), m))) AS loose, len(list_filter({s}, lambda m: contains(lower(t), m))) AS firm,
             len(list_filter({sh}, lambda m: contains(lower(t), m))) AS shell FROM d),
r AS (SELECT {key}, CASE WHEN t = '' THEN 'empty' WHEN shell > 0 AND loose = 0 THEN 'shell' WHEN length(t) < {least} THEN 'short'
             WHEN loose = 0 THEN 'no content marker' WHEN firm = 0 AND loose < {quorum} THEN 'no section' ELSE '' END AS reason FROM h)
SELECT {key}, CASE reason WHEN '' THEN 'usable' WHEN 'empty' THEN 'failed' ELSE 'thin' END AS status, reason FROM r
"""


@query(classify_sql(vocab.CONTENT, vocab.STRUCTURE, vocab.THIN_CHARS, vocab.LOOSE_QUORUM))
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01: state and reason of every document under the original markers."""
    return read(spark, sf_dir, "documents").withColumn("c", captures.classify("text")).select("doc_id", "c.status", "c.reason")


@query(classify_sql(OWN_CONTENT, OWN_STRUCTURE, 400, 2))
def classify_documents_own_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01: the same under markers that occur in the documents."""
    found = captures.classify("text", content=OWN_CONTENT, structure=OWN_STRUCTURE, least=400, quorum=2)
    return read(spark, sf_dir, "documents").withColumn("c", found).select("doc_id", "c.status", "c.reason")


@query(rf"""
WITH s AS ({classify_sql(OWN_CONTENT, OWN_STRUCTURE, 400, 2).strip()}),
k AS (SELECT unnest({quoted(vocab.STATUSES)}) AS status)
SELECT k.status, count(s.doc_id)::BIGINT AS n FROM k LEFT JOIN s ON k.status = s.status GROUP BY k.status
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01: documents by state, with zeros."""
    return captures.status_counts(classify_documents_own_markers(spark, sf_dir))


@query(rf"""
WITH p AS (SELECT page_id, {html_sql('html')} AS text, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages),
c AS ({classify_sql(OWN_CONTENT, OWN_STRUCTURE, 400, 2, "p", "page_id").strip()}),
s AS (SELECT CASE WHEN row_number() OVER (PARTITION BY host ORDER BY page_id) > 1 THEN 'duplicate' ELSE status END AS status FROM p JOIN c USING (page_id)),
k AS (SELECT unnest({quoted(vocab.STATUSES)}) AS status)
SELECT k.status, count(s.status)::BIGINT AS n FROM k LEFT JOIN s ON k.status = s.status GROUP BY k.status
""")
def page_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages by host, first one wins, text classified, states counted with zeros."""
    pages = read(spark, sf_dir, "pages").withColumn("host", identity.host("url"))
    marked = captures.first_wins(pages, "host", "page_id", "url")
    c = captures.classify(T.strip_html("html"), content=OWN_CONTENT, structure=OWN_STRUCTURE, least=400, quorum=2)
    states = marked.withColumn("status", F.when(F.col("is_duplicate"), "duplicate").otherwise(c["status"]))
    return captures.status_counts(states)


@query("SELECT doc_id, md5(text) AS md5, substr(sha1(text), 1, 6) AS short_hash, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN27: digests of every document."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha1("text"), 1, 6).alias("short_hash"), F.sha2("text", 256).alias("sha256"))


@query(r"""
WITH d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS line, source FROM documents),
g AS (SELECT line, source, min(doc_id) AS first_id, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY first_id) AS duplicate_group FROM g)
SELECT doc_id, coalesce(duplicate_group, 0)::BIGINT AS duplicate_group FROM d LEFT JOIN r ON d.line IS NOT DISTINCT FROM r.line AND d.source IS NOT DISTINCT FROM r.source
""")
def soft_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02: documents of one source with the same first line, groups numbered by first appearance, 0 for none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.element_at(F.split("text", "\n"), 1)).alias("line"), "source")
    return captures.soft_duplicates(docs, ["line", "source"], "doc_id").select("doc_id", F.coalesce("duplicate_group", F.lit(0)).alias("duplicate_group"))


@query(r"""
WITH cur AS (SELECT doc_id, 'new' AS origin FROM documents WHERE doc_id % 2 = 0), old AS (SELECT doc_id, 'old' AS origin FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM cur UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM cur)
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN02, SET01: a manifest of even documents keeps what an older one of every third had besides."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return captures.carry_forward(docs.where("doc_id % 2 = 0").withColumn("origin", F.lit("new")), docs.where("doc_id % 3 = 0").withColumn("origin", F.lit("old")), "doc_id")


@query(r"""
WITH old AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'thin' ELSE 'failed' END AS s FROM documents WHERE doc_id % 2 = 0)
SELECT documents.doc_id, CASE WHEN s = 'usable' THEN 'carry' WHEN s IS NOT NULL THEN 'retry' ELSE 'fetch' END AS action FROM documents LEFT JOIN old USING (doc_id)
""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR04: what a run does with each document after an earlier one over the even ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    old = docs.where("doc_id % 2 = 0").withColumn("status", F.expr("CASE doc_id % 4 WHEN 0 THEN 'usable' WHEN 1 THEN 'thin' ELSE 'failed' END"))
    return captures.plan_run(docs, old, "doc_id").select("doc_id", "action")


ATTEMPTS = values(
    [("a", 1, "thin", 2), ("a", 2, "usable", 2), ("a", 3, "usable", 1), ("b", 1, "usable", 1), ("b", 2, "usable", 1), ("b", 3, "thin", 0), ("c", 1, "failed", 2), ("c", 2, "thin", 2), ("c", 3, "thin", 0), ("d", 1, "usable", 0)],
    "k, attempt, status, missing",
)


@case(values([("a", 3, "usable", 1), ("b", 1, "usable", 1), ("c", 2, "thin", 2), ("d", 1, "usable", 0)], "k, attempt, status, missing"))
def attempt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN03: which attempt wins, as a fold."""
    return captures.fold_attempts(spark.sql(f"SELECT * FROM {ATTEMPTS}"), "k")


URLS = [
    (1, "https://jobs.ashbyhq.com/Acme/0b9e1c2d-1111-2222-3333-444455556666?src=x"), (2, "https://boards.greenhouse.io/asana/jobs/7392230"),
    (3, "https://job-boards.greenhouse.io/asana/jobs/7392230?gh_src=abc"), (4, "https://asana.com/jobs/apply/7392230/pm"),
    (5, "https://asanacareers.com/jobs/?gh_jid=7392230"), (6, "https://jobs.lever.co/findem/0b9e1c2d-1111-2222-3333-444455556666/apply"),
    (7, "https://www.linkedin.com/jobs/view/4012345678/"), (8, "https://www.Example.com/a/?b=2&a=1&utm_source=z"), (9, "https://apply.workable.com/feeld/j/AA731B2DD7?x=1"),
]
KEYS = [
    "ashby:acme:0b9e1c2d-1111-2222-3333-444455556666", "greenhouse:asana:7392230", "greenhouse:asana:7392230", "greenhouse:asana:7392230",
    "greenhouse:asana:7392230", "lever:findem:0b9e1c2d-1111-2222-3333-444455556666", "linkedin:4012345678", "https://example.com/a?a=1&b=2",
    "https://apply.workable.com/feeld/j/AA731B2DD7?x=1",
]
ADAPTERS = ["ashby", "greenhouse", "greenhouse", None, None, "lever", "linkedin", None, "workable"]


@case(values([(i, k, a) for (i, _), k, a in zip(URLS, KEYS, ADAPTERS)], "pos, capture_key, adapter"))
def capture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ01, PRJ03, SRC02: keys and adapters of addresses."""
    return spark.sql(f"SELECT * FROM {values(URLS, 'pos, url')}").select("pos", identity.capture_key("url").alias("capture_key"), identity.route("url").alias("adapter"))


@query(r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS line, 'https://' || source || '.example.com/' || doc_id AS u FROM documents),
s AS (SELECT *, left(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS a,
             left(regexp_replace(regexp_replace(lower(trim(string_split(string_split(line, '|')[1], ' - ')[1])), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS b FROM d),
n AS (SELECT *, (CASE a WHEN '' THEN 'job' ELSE a END) || '__' || (CASE b WHEN '' THEN 'job' ELSE b END) AS base FROM s)
SELECT doc_id, base || (CASE WHEN first_value(u) OVER (PARTITION BY base ORDER BY doc_id) <> u THEN '-' || left(sha1(u), 6) ELSE '' END) || '.txt' AS filename FROM n
""")
def unique_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: a file name for every document by source and first line, later ones of a taken name with a hash."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("company"), F.element_at(F.split("text", "\n"), 1).alias("title"), url.alias("key"), url.alias("url"))
    return identity.with_filenames(docs).select(F.col("pos").alias("doc_id"), "filename")
