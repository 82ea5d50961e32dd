"""Boards and feeds behind addresses, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, titles
from .registry import literal, query, read, spread

HEX = "md5(concat('j', {0}))"
UUID = "concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), substring({h}, 13, 4), substring({h}, 17, 4), substring({h}, 21, 12))"


def uuid(what: str) -> str:
    return UUID.format(h=HEX.format(what))


def uuid_once(what: str) -> str:
    """The same with one digest, not five, for expressions that run here."""
    return f"regexp_replace({HEX.format(what)}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"


@query(f"""
WITH f AS (SELECT 'org' || l_orderkey AS org, {uuid("l_orderkey || '-' || l_linenumber")} AS id, 'Role ' || min(l_returnflag) AS title FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT o_orderkey, 'org' || o_orderkey AS org, {uuid("o_orderkey || '-' || (1 + o_custkey % 4)")} AS id FROM orders WHERE o_custkey % 3 > 0)
SELECT o_orderkey, org, id AS posting_id, title FROM p JOIN f USING (org, id)
""")
def feed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03: postings of all orders' addresses in feeds of all lines, ids in capitals there; every third has no id."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("concat('org', l_orderkey) AS org", f"upper({uuid_once('concat(l_orderkey, \"-\", l_linenumber)')}) AS id", "concat('Role ', l_returnflag) AS title")
    feeds = lines.groupBy("org").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "title")).alias("jobs"))).alias("body"))
    address = f"concat('https://jobs.ashbyhq.com/org', o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN concat('/', {uuid_once('concat(o_orderkey, \"-\", 1 + o_custkey % 4)')}, '/application?x=1') ELSE '' END)"
    return boards.feed_lookup(read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{address} AS url"), feeds, "o_orderkey")


# pages at addresses and with markup of eight kinds by order, each with the board that is right for it, or none
KINDS = [
    ("careers.brand{c}.com/positions/{n}", "", "brand{c}"), ("www.brand{c}careers.com/jobs?gh_jid={n}", "", "brand{c}"), ("onebrand{c}.com/x/{n}", "", "brand{c}"), ("jobs.get-brand{c}.io/{n}/apply", "", "brand{c}"),
    ("x.example.org/{n}", '<iframe src="https://boards.greenhouse.io/embed/job_app?for=Brand{c}&token=1">', "brand{c}"), ("y.example.org/{n}", '<a href="https://job-boards.greenhouse.io/brand{c}/jobs/1">', "brand{c}"),
    ("brand{c}.com/{n}", '<script src="https://boards.greenhouse.io/embed/job_board/js?for=other{c}">', "other{c}"), ("nowhere.net/{n}", "", None),
]


def _kind(place: int) -> str:
    made = lambda t: "concat('" + t.replace("{c}", "', o_custkey, '").replace("{n}", "', 1000000 + o_orderkey, '") + "')"
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if k[place] is None else made(k[place])}" for i, k in enumerate(KINDS)) + " END"


# whose titles differ: by customer, a board's title is the page's, stands in its text, or is another posting's
@query(f"""
WITH p AS (SELECT o_orderkey, o_custkey, {_kind(2)} AS board, o_orderkey % 8 IN (4, 5, 6) AS sure FROM orders)
SELECT o_orderkey, board, (1000000 + o_orderkey)::VARCHAR AS job_id, 'Senior Analyst ' || o_custkey AS title, sure FROM p WHERE board IS NOT NULL AND (sure OR o_custkey % 3 < 2)
""")
def embedded_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC08: boards of all orders' pages, named in markup or guessed from the domain and held against titles and texts."""
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    title = "CASE o_custkey % 3 WHEN 0 THEN concat('The Senior Analyst, ', o_custkey) ELSE concat('Driver ', o_orderkey) END"
    body = "CASE o_custkey % 3 WHEN 1 THEN concat('We seek an analyst (', o_custkey, '), senior by years') ELSE 'We seek you' END"
    pages = o.selectExpr("o_orderkey", f"concat('https://', {_kind(0)}) AS url", f"{title} AS title", f"{_kind(1)} AS html", f"{body} AS text")
    each = o.selectExpr("explode(array(concat('brand', o_custkey), concat('other', o_custkey))) AS board", "1000000 + o_orderkey AS job_id", "concat('Senior Analyst ', o_custkey) AS title", "o_orderkey % 8 AS kind")
    return boards.recover(pages, each.where("kind <> 7"), "o_orderkey")


# what pages say: the title with the site's name behind it, the site's name alone, a heading, a heading on every page
KINDS_SAID = ["title", "heading", "line"]
SAID = "VALUES " + ", ".join(f"({i}, {literal(k)})" for i, k in enumerate(KINDS_SAID))
EVIDENCE = """
  CASE kind WHEN 'title' THEN CASE page_id % 4 WHEN 0 THEN concat(own, ' | Site ', host) WHEN 1 THEN concat('Site ', host) WHEN 2 THEN concat('Careers at ', host) ELSE concat('Jobs', ' - ', own, ' — Team ', page_id, ' | site ', host) END
            WHEN 'heading' THEN CASE page_id % 3 WHEN 0 THEN concat('Welcome · ', 'Site ', host) ELSE concat(own, ' · Site ', host) END
            ELSE CASE page_id % 5 WHEN 0 THEN 'Open Roles' ELSE concat('Join ', host) END END"""
OWN = "substring(concat('Role ', replace(replace(replace(replace(url, '|', ''), '-', ''), '?', ''), '#', '')), 1, 60)"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {OWN} AS own FROM pages),
e AS (SELECT page_id, host, rank, {EVIDENCE} AS text FROM p, (SELECT * FROM ({SAID}) AS t(rank, kind))),
s AS (SELECT page_id, host, rank, unnest(range(len(ps))) AS pos, unnest(ps) AS part FROM (SELECT page_id, host, rank, list_filter(list_transform(string_split_regex(text, '\\s+[|·•–—-]\\s+|\\s*[|·•]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM e)),
k AS (SELECT * FROM s WHERE lower(part) NOT IN ({", ".join(literal(c) for c in titles.CHROME)}) AND NOT ({" OR ".join(f"starts_with(lower(part), {literal(c)})" for c in titles.PREFIXES)})),
n AS (SELECT host, lower(part) AS low, count(DISTINCT page_id) AS n FROM k GROUP BY ALL),
h AS (SELECT host, count(DISTINCT page_id) AS pages FROM p GROUP BY host),
x AS (SELECT n.host, low FROM n JOIN h USING (host) WHERE n >= 3 AND 2 * n > pages),
o AS (SELECT * FROM k WHERE (host, lower(part)) NOT IN (SELECT host, low FROM x)),
r AS (SELECT page_id, rank, string_agg(part, ' - ' ORDER BY pos) AS role FROM o GROUP BY ALL)
SELECT page_id, arg_min(role, rank) AS role, min(rank)::INT AS rank FROM r GROUP BY page_id
""".replace("\\\\", "\\"))
def recovered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ05: the role that each page's titles, headings and lines name, once what its host's pages share is taken off."""
    pages = read(spark, sf_dir, "pages").selectExpr("page_id", "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host", f"{OWN} AS own")
    said = pages.select("*", F.posexplode(F.array(*[F.lit(k) for k in KINDS_SAID])).alias("rank", "kind"))
    return titles.recover_roles(said.selectExpr("page_id", "host", "rank", f"{EVIDENCE} AS text"), "page_id")
