"""Payload parsers, lists, Markdown, captures and the last miners over authored rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, miners, names, questions, scores
from ..functions import text as T
from ..operators import artifacts, captures, gates, identity
from ..sources import files, payloads, writers
from .registry import case, query, read, values

UUID = "0b9e1c2d-1111-2222-3333-444455556666"
BODIES = [
    (f"https://jobs.ashbyhq.com/better-up/{UUID}", {"id": UUID, "title": "PM", "employmentType": "FullTime", "location": "NYC", "secondaryLocations": [{"location": "SF"}], "publishedAt": "2026-06-13T09:05:32-04:00", "descriptionPlain": "hi"}, ("ashby", "PM", "Better Up", "NYC; SF", "2026-06-13")),
    ("https://boards.greenhouse.io/bloomerang/jobs/4705550005", {"id": 4705550005, "title": "Lead", "content": "x", "location": {"name": "Remote"}, "first_published": "2026-01-02"}, ("greenhouse", "Lead", "Bloomerang", "Remote", "2026-01-02")),
    (f"https://jobs.lever.co/findem/{UUID}", {"text": "Eng", "categories": {"allLocations": ["NYC", "SF"]}, "createdAt": 1782932070272}, ("lever", "Eng", "Findem", "NYC; SF", "2026-07-01")),
    ("https://ats.rippling.com/acme/jobs/x", {"uuid": "x", "name": "Ops", "workLocations": ["NYC"], "createdOn": "2026-02-02"}, ("rippling", "Ops", "Acme", "NYC", "2026-02-02")),
    ("https://apply.workable.com/feeld/j/AA", {"shortcode": "AA", "title": "CPO", "locations": [{"city": "London", "country": "UK", "hidden": False}, {"city": "Paris", "hidden": True}], "published": "2026-02-03"}, ("workable", "CPO", "Feeld", "London, UK", "2026-02-03")),
    ("https://a.wd1.myworkdayjobs.com/x", {"jobPostingInfo": {"title": "Dir", "postedOn": "Posted 30 Days Ago", "startDate": "2026-03-04", "location": "NY"}, "hiringOrganization": {"name": "Wonder"}}, ("workday", "Dir", "Wonder", "NY", "2026-03-04")),
]


@case(values([(u, *e) for u, _, e in BODIES], "url, source, title, company, location, posted_date"))
def payload_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC02, SRC03, SRC05, SRC07, SRC09, SRC10, SRC11, SRC12: postings of six systems as one table."""
    rows = spark.sql(f"SELECT * FROM {values([(u, json.dumps(b)) for u, b, _ in BODIES], 'url, body')}")
    return payloads.postings(rows, identity.route("url")).select("url", "source", "title", "company", "location", "posted_date")


LD = {"@type": "JobPosting", "title": "t1", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}, "datePosted": "2026-05-06", "hiringOrganization": {"name": "Org"}}
PAGES = [("u", f'<title>T | x</title><meta property="og:title" content="OG"><script type="application/ld+json">{json.dumps(LD)}</script><p>b</p>'), ("v", "<h1>Head</h1>")]


@case(values([("u", "OG", "t1", "Org", "Austin, TX"), ("v", "Head", None, None, None)], "url, page_title, title, company, location"))
def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13, SRC14, PRJ07: titles of pages, and the postings that they declare."""
    pages = spark.sql(f"SELECT * FROM {values(PAGES, 'url, html')}")
    own = payloads.json_ld(pages).select("url", "title", "company", "location")
    return payloads.page(pages).select("url", F.col("title").alias("page_title")).join(own, "url", "left")


CARD = '<h2 class="top-card-layout__title x">PM</h2><a class="topcard__org-name-link" href="#">Acme</a><span class="topcard__flavor topcard__flavor--bullet">NYC</span><time datetime="2026-07-07">now</time><div class="show-more-less-html__markup"><p>Salary: $150,000 - $170,000</p></div>'


@case(values([("https://www.linkedin.com/jobs/view/pm-4012345678", "4012345678", "PM", "Acme", "NYC", "Salary: $150,000 - $170,000", "2026-07-07")], "url, posting_id, title, company, location, compensation, posted_date"))
def linkedin_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06: a guest fragment."""
    rows = spark.sql(f"SELECT * FROM {values([('https://www.linkedin.com/jobs/view/pm-4012345678', CARD)], 'url, html')}")
    return payloads.linkedin(rows).select("url", "posting_id", "title", "company", "location", "compensation", "posted_date")



@query("""
WITH p AS (SELECT source AS url, CASE WHEN doc_id % 3 = 0 THEN 'body' ELSE 's' || doc_id END AS selector, text, length(text) - CASE WHEN doc_id % 3 = 0 THEN 500 ELSE 0 END AS size FROM documents)
SELECT url, arg_max(selector, (size, selector)) AS selector, md5(arg_max(text, (size, selector))) AS text_md5 FROM p GROUP BY url
""")
def best_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: the longest part of a page; a source is a page, its documents parts."""
    d = read(spark, sf_dir, "documents")
    parts = d.select(F.col("source").alias("url"), F.when(F.col("doc_id") % 3 == 0, "body").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("selector"), "text")
    return payloads.best_text(parts).select("url", "selector", F.md5("text").alias("text_md5"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'ats')")
def engine_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: attempts of one engine."""
    return payloads.engine(read(spark, sf_dir, "events").withColumnRenamed("event_type", "method"), "click").select("event_id")


APPLY = [("https://jobs.ashbyhq.com/acme/x?src=1", "https://jobs.ashbyhq.com/acme/x/application"), ("https://jobs.lever.co/a/x/apply", "https://jobs.lever.co/a/x/apply"), ("https://apply.workable.com/f/j/A", "https://apply.workable.com/f/j/A/apply/"), ("https://plain.org", None)]


@case(values([(i, b) for i, (_, b) in enumerate(APPLY)], "pos, apply_url"))
def apply_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: where to apply."""
    return spark.sql(f"SELECT * FROM {values([(i, a) for i, (a, _) in enumerate(APPLY)], 'pos, u')}").select("pos", identity.apply_url("u").alias("apply_url"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), 'L') GROUP BY doc_id
""")
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, SRC27: lines of lists without blank ones and comments; a document is a list, L its mark of comments."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where((T.strip("line") != "") & ~T.strip("line").startswith("L")).groupBy("doc_id").agg(F.count("*").alias("n"))


LOG = "# log\n## 1/2/26 - 1/5/26 b\nx\n## Pre-history\ny\n## 3/4/26\nz\n## Earlier\n## odd"
INDEX = "# i\n### Old\nregistered 2025-01-02\n### None\ntext\n### New\nregistered 2026-01-02"


@case(values([(1, "3/4/26", "New"), (2, "1/2/26 - 1/5/26 b", "Old"), (3, "Pre-history", "None"), (4, "Earlier", None), (5, "odd", None)], "place, section, base"))
def markdown_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23, SRC24, SRT02, SRT03: sections of a changelog and bases of an index in their order."""
    from ..operators.order import numbered

    rows = spark.sql(f"SELECT * FROM {values([(LOG, INDEX)], 'log, text')}")
    kinds = rows.select(F.posexplode(files.changelog(F.col("log"))).alias("idx", "s")).select("idx", "s.*")
    rank = F.when(F.col("kind") == "dated", 0).when(F.col("kind") == "pre-history", 1).when(F.col("kind") == "earlier", 2).otherwise(3)
    a = numbered(kinds, [rank, F.desc("end"), F.desc("start"), F.col("idx")], "place").select("place", F.col("title").alias("section"))
    b = numbered(gates.ledger_of_bases(rows), [F.desc(F.coalesce("registered", F.lit(""))), F.col("pos")], "place").select("place", F.col("title").alias("base"))
    return a.join(b, "place", "left")


@case(values([("a b", "<!-- processed-commit: 89abcde -->\na b", "89abcde")], "t, marked, commit"))
def processed_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15: the marker of a changelog, put in and replaced."""
    once = spark.sql(f"SELECT * FROM {values([('a b', 1)], 't, n')}").withColumn("m", files.with_processed_commit(F.col("t"), F.lit("1234567")))
    marked = files.with_processed_commit(F.col("m"), F.lit("89abcde"))
    return once.select("t", marked.alias("marked"), files.processed_commit(marked).alias("commit"))


@query("""
SELECT c_nationkey AS folder, arg_min(c_custkey, (CASE c_mktsegment WHEN 'MACHINERY' THEN 1 ELSE 2 END, lpad(c_custkey::VARCHAR, 12, '0')))::BIGINT AS c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') GROUP BY c_nationkey
""")
def artifact_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC28, SRC30: the first artifact of a folder in the order of places; segments are places."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("place"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("path"))
    return files.first_by_priority(c, ["MACHINERY", "BUILDING"]).select("folder", F.col("path").cast("long").alias("c_custkey"))


LISTING = [("f", "f/My Resume.pages"), ("f", "f/MyResume.pdf"), ("g", "g/CV.pages"), ("g", "g/CV FULL.pdf")]


@case(values([("f/My Resume.pages", "ok", "f/MyResume.pdf"), ("g/CV.pages", "no-readable-pdf", None)], "path, status, pdf"))
def readable_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC29: the PDF of a document, never a bundle."""
    return artifacts.readable(spark.sql(f"SELECT * FROM {values(LISTING, 'folder, path')}"))


WRITTEN = [(1, "https://a.com/x", "A", "PM", None, "$1", "u", "body\n\n kept", "usable", "a.txt"), (2, "https://b.com", None, None, None, None, None, None, "failed", "b.txt")]
HEAD = "Company: {}\nRole: {}\nWorking Location(s): Employer did not mention\nEmployment Type: Employer did not mention\nBase Salary: {}\nPosted: Employer did not mention\nApply URL: {}\nJob Posting URL: {}\nCaptured: Time Unavailable\n\n=== JOB POST START ===\n{}\n=== JOB POST END ==="
NO = "Employer did not mention"


@case(values([("a.txt", HEAD.format("A", "PM", "$1", "u", "https://a.com/x", "body\n\n kept"), "https://a.com/x", "body\n\n kept"), ("b.txt", "QUARANTINED: empty\n" + HEAD.format(NO, NO, NO, NO, "https://b.com", ""), "https://b.com/", "")], "filename, text, capture_key, body"))
def capture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK01, SNK02, PRJ04: captures and stubs as text, and what is read back from them."""
    rows = spark.sql(f"SELECT * FROM {values(WRITTEN, 'pos, url, company, title, location, compensation, apply_url, text, status, filename')}")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"employment_type": none, "posted_date": none, "fetched_at": F.lit(None).cast("timestamp"), "reason": F.lit("empty")})
    made = rows.select("filename", F.when(F.col("status") == "usable", writers.capture_text()).otherwise(writers.stub_text()).alias("text"))
    return made.select("filename", "text", identity.written_key("text").alias("capture_key"), writers.body_of(F.col("text")).alias("body"))



@case(values([("a", "x=== JOB POST END ===\nCapture History:\nh", True), ("b", "y=== JOB POST END ===\nCapture History:\nk", False), ("c", "z", False)], "filename, text, changed"))
def capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK14: histories rendered behind bodies, unchanged ones told apart."""
    rows = spark.sql(f"SELECT * FROM {values([('a', 'x=== JOB POST END ==='), ('b', 'y=== JOB POST END ===' + chr(10) + 'Capture History:' + chr(10) + 'k'), ('c', 'z')], 'filename, text')}")
    history = spark.sql(f"SELECT * FROM {values([('a', 'h'), ('b', 'k')], 'filename, history')}")
    return writers.with_history(rows, history, "filename").select("filename", "text", "changed")


DAYS = [("June 13, 2026", "2026-06-13", "2026-06-13T10:00:00", "June 13, 2026"), ("2026-06-13", "2026-06-13", "soon", "soon"), ("soon", "", "2026-01-02", "January 2, 2026")]


@case(values([(i, d[1], d[3]) for i, d in enumerate(DAYS)], "pos, read_back, human"))
def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN10, FN11: dates read back and written out."""
    rows = spark.sql(f"SELECT * FROM {values([(i, d[0], d[2]) for i, d in enumerate(DAYS)], 'pos, a, b')}")
    return rows.select("pos", dates.capture_date("a").alias("read_back"), dates.human_date("b").alias("human"))


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%B %-d, %Y at %-I:%M %p ET') AS captured FROM events")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11: times on the Eastern clock, summer time and all."""
    return read(spark, sf_dir, "events").select("event_id", dates.capture_time("ts").alias("captured"))


OFFERED = [
    ("Benefits:\n- Health\n- Dental\n\nApply now", "Health; Dental", "Employer did not mention additional compensation."), ("Salary + benefits. We may be eligible for equity and bonus.", "Mentioned (no details)", "Bonus and equity mentioned, but details not provided."),
    ("You get 0.5% equity vesting over 4 years", None, "You get 0."), ("nothing", None, "Employer did not mention additional compensation."),
]
OFFERED[2] = ("You get 5000 RSUs vesting over 4 years", None, "You get 5000 RSUs vesting over 4 years.")


@case(values([(i, o[1], o[2]) for i, o in enumerate(OFFERED)], "pos, benefits, additional"))
def offered_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18, FN19, FLT09: benefits and pay beyond base, told or only mentioned."""
    rows = spark.sql(f"SELECT * FROM {values([(i, o[0]) for i, o in enumerate(OFFERED)], 'pos, t')}")
    return rows.select("pos", miners.benefits("t").alias("benefits"), miners.additional_pay("t").alias("additional"))


EDITS = [
    (None, "a", "", "Previous capture was not available for comparison."), ("Responsibilities: a.\n$5", "Responsibilities: a.", "Compensation", "No material changes detected."), ("- One thing.\n- Two", "Two\nOne thing.", "", "Employer content unchanged; source list formatting restored."),
    ("Your experience counts.", "Your experience counts more.", "", "Employer materially updated the posting."), ("same", "same", "", "No material changes detected."),
]
EDITS[1] = ("Responsibilities: a.\nsalary of 5", "Responsibilities: a.", "Compensation", "Employer materially updated the posting.")


@case(values([(i, e[2], e[3]) for i, e in enumerate(EDITS)], "pos, lost, note"))
def body_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG06, AGG07: regions that a new body lost, and whether the employer changed the posting."""
    rows = spark.sql(f"SELECT * FROM {values([(i, e[0], e[1]) for i, e in enumerate(EDITS)], 'pos, a, b')}")
    return rows.select("pos", F.array_join(miners.lost_regions("a", "b"), ", ").alias("lost"), miners.material_change("a", "b").alias("note"))


@case(values([(0, "added:place,corrected:base")], "pos, changes"))
def capture_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN25: what a new capture added or corrected."""
    old = "Posted: 2026-01-01\nWorking Location(s): Unknown\nBase Salary: $5"
    new = "Posted: 2026-01-01\nWorking Location(s): NYC\nBase Salary: $6"
    return spark.sql(f"SELECT * FROM {values([(0, old, new)], 'pos, a, b')}").select("pos", F.array_join(miners.field_changes("a", "b"), ",").alias("changes"))


FORM = {"questions": [{"label": "Why us?", "required": True, "fields": [{"name": "q_1", "type": "textarea", "values": []}]}, {"label": "Email", "required": True, "fields": [{"name": "email", "type": "input_text", "values": []}]}, {"label": "Will you attend the office 3 days per week?", "required": True, "fields": [{"name": "q_2", "type": "multi", "values": [{"label": "Yes"}, {"label": "NYC"}]}]}]}


@case(values([("u", "Why us? | Will you attend the office 3 days per week?", "substantive | logistical", "SF; NYC")], "url, labels, classes, place"))
def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21, FN26, FLT08: questions of a payload, kept ones with classes, and the metros that they offer."""
    rows = spark.sql(f"SELECT * FROM {values([('u', json.dumps(FORM))], 'url, body')}")
    kept = payloads.greenhouse_questions(rows).withColumn("q", questions.filter_questions("questions"))
    return kept.select("url", F.array_join(F.transform("q", lambda q: q["label"]), " | ").alias("labels"), F.array_join(F.transform("q", lambda q: q["question_class"]), " | ").alias("classes"), miners.fold_cadence(F.lit("SF"), "q").alias("place"))


SMALL = [("orNew and Old", "or New and Old", "greenhouse-boards-api", True, "07-17-26", True), ("of course", "of course", "requests/html", False, "7-17-26", False)]


@case(values([(i, s[1], s[3], s[5]) for i, s in enumerate(SMALL)], "pos, repaired, structured, batch_ok"))
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN15, FLT04, SNK12: fused words, structured sources, names of batches."""
    rows = spark.sql(f"SELECT * FROM {values([(i, s[0], s[2], s[4]) for i, s in enumerate(SMALL)], 'pos, t, s, b')}")
    return rows.select("pos", T.repair_fusion("t").alias("repaired"), captures.structured_source("s").alias("structured"), dates.batch_name("b").alias("batch_ok"))


@case(values([(0, "Jo Doe-Resume - Acme - Senior PM.pdf")], "pos, filename"))
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: names of artifacts."""
    return spark.sql(f"SELECT * FROM {values([(0, 'Jo Doe', 'Acme', 'Sr. Product Manager')], 'pos, who, co, role')}").select("pos", names.artifact_name("who", "co", "role").alias("filename"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '⚠️ NEEDS RE-FETCH' ELSE o_orderstatus END AS status, o_orderstatus <> 'P' AS counted FROM orders")
def refetch_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPC04: rows with unverified content are marked and left out of the banner."""
    mark = scores.refetch_status("o_orderstatus", F.col("o_orderstatus") == "P")
    return read(spark, sf_dir, "orders").select("o_orderkey", mark["status"].alias("status"), mark["counted"].alias("counted"))
