"""Payload parsers, files, writers and streams on small authored rows."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack.functions import questions
from lodestack.operators import identity, log
from lodestack.sources import files, payloads, writers
from lodestack.streaming import log as stream

UUID = "0b9e1c2d-1111-2222-3333-444455556666"


def one(spark, adapter, url, body):
    return adapter(spark.createDataFrame([(url, body if isinstance(body, str) else json.dumps(body))], "url string, body string")).first()


def test_ashby(spark):
    comp = {"compensationTiers": [{"title": "t", "components": [{"summary": "$200K – $250K", "compensationType": "Salary"}, {"summary": "0.1%", "compensationType": "EquityPercentage"}]}]}
    body = {"id": UUID, "title": "PM", "employmentType": "FullTime", "location": "NYC", "secondaryLocations": [{"location": "SF"}, {"location": "NYC"}], "publishedAt": "2026-06-13T09:05:32-04:00", "isRemote": True, "descriptionHtml": "<p>hi</p>", "compensation": comp, "jobUrl": "u"}
    r = one(spark, payloads.ashby, f"https://jobs.ashbyhq.com/better-up/{UUID}", body)
    assert (r.title, r.company, r.location, r.employment_type, r.remote, r.compensation, r.posted_date, r.text, r.apply_url) == ("PM", "Better Up", "NYC; SF", "Full Time", True, "$200K – $250K", "2026-06-13", "hi", "u")


def test_greenhouse(spark):
    field = {"name": "q_1", "type": "textarea", "values": []}
    body = {"id": 4705550005, "title": "PM", "absolute_url": "a", "content": "&lt;p&gt;duties&lt;/p&gt;", "location": {"name": "Remote"}, "first_published": "2026-01-02T00:00:00Z", "pay_input_ranges": [{"min_cents": 15000050, "max_cents": 20000000, "currency_type": "USD"}], "questions": [{"label": "Why us?", "required": True, "fields": [field]}, {"label": "Email", "required": True, "fields": [{"name": "email", "type": "input_text", "values": []}]}]}
    url = "https://boards.greenhouse.io/bloomerang/jobs/4705550005"
    r = one(spark, payloads.greenhouse, url, body)
    assert (r.company, r.compensation, r.text, r.posting_id, r.posted_date) == ("Bloomerang", "USD 150,000–200,000", "duties", "4705550005", "2026-01-02")
    named = spark.createDataFrame([("Bloomerang", "Bloomerang Inc")], "board string, name string")
    assert one(spark, lambda d: payloads.greenhouse(d, named), url, body).company == "Bloomerang Inc"
    rows = payloads.greenhouse_questions(spark.createDataFrame([(url, json.dumps(body))], "url string, body string"))
    kept = rows.select(questions.filter_questions("questions").alias("q")).first().q
    assert [(q.label, q.question_class) for q in kept] == [("Why us?", "substantive")]


def test_lever_rippling_workable_workday(spark):
    r = one(spark, payloads.lever, f"https://jobs.lever.co/findem/{UUID}", {"text": "PM", "categories": {"allLocations": ["NYC", "SF"], "commitment": "Full-time"}, "createdAt": 1782932070272, "description": "a", "lists": [{"text": "b", "content": "<li>c</li>"}], "additional": "d", "salaryRange": {"min": 100000, "max": 120000, "currency": "USD"}, "workplaceType": "remote", "hostedUrl": "h"})
    assert (r.location, r.posted_date, r.text, r.compensation, r.remote, r.posting_id) == ("NYC; SF", "2026-07-01", "a\nb\nc\nd", "USD 100,000–120,000", True, UUID)
    r = one(spark, payloads.rippling, "https://ats.rippling.com/acme/jobs/x", {"uuid": "x", "name": "PM", "description": {"company": "c", "role": "r"}, "workLocations": ["Remote (US)", "NYC"], "employmentType": {"label": "SALARIED_FT", "id": "Full-time"}, "payRangeDetails": [{"location": "NYC", "currency": "USD", "rangeStart": 1e5, "rangeEnd": 1.5e5}]})
    assert (r.remote, r.employment_type, r.compensation) == (False, "Full-time", "NYC: USD 100,000–150,000")
    r = one(spark, payloads.workable, "https://apply.workable.com/feeld/j/AA?x=1", {"shortcode": "AA", "title": "CPO", "locations": [{"city": "London", "country": "UK", "hidden": False}, {"city": "Paris", "hidden": True}], "published": "2026-02-03", "description": "x"})
    assert (r.location, r.apply_url, r.company) == ("London, UK", "https://apply.workable.com/feeld/j/AA/apply/", "Feeld")
    r = one(spark, payloads.workday, "https://a.wd1.myworkdayjobs.com/x", {"jobPostingInfo": {"title": "PM", "postedOn": "Posted 30 Days Ago", "startDate": "2026-03-04", "location": "NY"}, "hiringOrganization": {"name": "Wonder"}})
    assert (r.company, r.posted_date, r.location) == ("Wonder", "2026-03-04", "NY")


@pytest.mark.parametrize("adapter", payloads.ADAPTERS.values())
def test_bodies_that_are_none(spark, adapter):
    for body in ("not json", "", None, "{}", "[]"):
        r = adapter(spark.createDataFrame([("https://x.y/z", body)], "url string, body string")).first()
        assert r.title is None and r.posted_date is None


def test_routing(spark):
    rows = [(f"https://jobs.ashbyhq.com/a/{UUID}", json.dumps({"title": "one"})), ("https://jobs.lever.co/b/c", json.dumps({"text": "two"})), ("https://plain.org/x", "{}")]
    frame = spark.createDataFrame(rows, "url string, body string")
    assert sorted((r.source, r.title) for r in payloads.postings(frame, identity.route("url")).collect()) == [("ashby", "one"), ("lever", "two")]


def test_json_ld_and_pages(spark):
    ld = {"@graph": [{"@type": "Organization", "name": "x"}, {"@type": "JobPosting", "title": "t0"}, {"@type": "JobPosting", "title": "t1", "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}, "datePosted": "2026-05-06"}]}
    html = f'<title>T | x</title><meta property="og:title" content="OG"><script type="application/ld+json">{json.dumps(ld)}</script><h1>H</h1><p>body</p>'
    pages = spark.createDataFrame([("u", html), ("v", "<p>nothing</p>"), ("w", None)], "url string, html string")
    got = payloads.json_ld(pages).collect()
    assert [(r.url, r.title, r.location, r.posted_date) for r in got] == [("u", "t1", "Austin, TX", "2026-05-06")]
    assert {r.url: r.title for r in payloads.page(pages).collect()} == {"u": "OG", "v": None, "w": None}


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\n a \nb\r\n#c\n")
    assert [r.value for r in files.name_list(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()] == ["a", "b"]
    for name, text in (("m1/prep-manifest.json", json.dumps({"entries": [{"original_url": "u", "status": "usable", "fetched_at": "2026-01-01T00:00:00"}, {"status": "duplicate", "fetched_at": "x"}, {"status": "thin"}]})), ("m2/prep-manifest.json", "{broken"), ("m2/other.json", "{}")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.original_url for r in files.manifests(spark, str(tmp_path)).collect()] == ["u"]
    (tmp_path / "t.csv").write_text(' Company ,Score\nA,"12"\n"B\nb",x\n,\n')
    got = files.tracker_csv(spark, str(tmp_path / "t.csv"), ["Score"]).collect()
    assert [(r["Company"], r["Score"], r["Score#"]) for r in got] == [("A", "12", 12), ("B\nb", "x", None)]


def test_markdown(spark):
    text = "# log\n## 1/2/26 - 1/5/26 b\nx\n## Pre-history\ny\n## 3/4/26\nz\n## Earlier\n## odd"
    rows = spark.createDataFrame([(text,)], "t string").select(F.posexplode(files.changelog(F.col("t"))).alias("idx", "s")).select("idx", "s.*")
    assert [r.title for r in files.sorted_changelog(rows).collect()] == ["3/4/26", "1/2/26 - 1/5/26 b", "Pre-history", "Earlier", "odd"]
    marked = spark.createDataFrame([("abc",)], "t string").select(files.with_processed_commit(F.col("t"), F.lit("1234567")).alias("t"))
    again = marked.select(files.with_processed_commit(F.col("t"), F.lit("89abcde")).alias("t"))
    assert again.first().t == "<!-- processed-commit: 89abcde -->\nabc" and again.select(files.processed_commit(F.col("t"))).first()[0] == "89abcde"


def test_settings_and_priority(spark):
    assert files.settings({"a": {"x": 1}, "b": 2}, {"a": {"x": 0, "y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 2}
    rows = spark.createDataFrame([("f", "b", "2"), ("f", "a", "1"), ("g", "z", "3"), ("f", "a", "0")], "folder string, place string, path string")
    assert [tuple(r) for r in files.first_by_priority(rows, ["a", "b"]).collect()] == [("f", "0")]


def test_captures_round_trip(spark, tmp_path):
    cols = "pos int, url string, company string, title string, location string, employment_type string, compensation string, posted_date string, apply_url string, text string, fetched_at timestamp, status string, reason string, filename string"
    import datetime

    when = datetime.datetime(2026, 7, 1, 16, 30)
    rows = spark.createDataFrame([(1, "https://a.com/x", "A", "PM", None, "", "$1", "2026-01-01", "u", "body\n\n  kept ", when, "usable", "", "a.txt"), (2, "https://b.com", None, None, None, None, None, None, None, None, None, "failed", "empty", "b.txt")], cols)
    writers.write_captures(rows, str(tmp_path / "c"))
    back = {r.filename: r for r in spark.read.parquet(str(tmp_path / "c")).select("*", writers.body_of(F.col("text")).alias("body"), identity.written_key("text").alias("key")).collect()}
    assert back["a.txt"].body == "body\n\n  kept " and "Working Location(s): Employer did not mention" in back["a.txt"].text and back["a.txt"].key == "https://a.com/x"
    assert "July 1, 2026 at 12:30 PM ET" in back["a.txt"].text and back["b.txt"].text.startswith("QUARANTINED: empty")
    assert {r.status: r.n for r in writers.write_manifest(rows.select("status", "filename"), str(tmp_path / "m")).collect()} == {"usable": 1, "failed": 1, "thin": 0, "duplicate": 0, "needs-review": 0}
    assert writers.report(rows).where("status = 'failed'").first().lines == "- Unknown: Unknown Title"
    history = spark.createDataFrame([("a.txt", "first: x")], "filename string, history string")
    captures = spark.read.parquet(str(tmp_path / "c"))
    once = writers.with_history(captures, history, "filename")
    assert {r.filename: r.changed for r in once.collect()} == {"a.txt": True, "b.txt": False}
    assert not any(r.changed for r in writers.with_history(once.drop("changed"), history, "filename").collect())


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_id").cast("string").alias("url"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert sorted(map(tuple, run(stream.states(source()), "states", "complete").collect())) == sorted(map(tuple, log.state(events).collect()))
    tumbling = run(stream.counts(source(), "1 day", lateness="3650 days"), "counts", "complete")
    assert tumbling.agg(F.sum("n")).first()[0] == events.count()
    sliding = run(stream.counts(source(), "2 days", "1 day", lateness="3650 days"), "sliding", "complete")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * events.count()
    seen = run(stream.sessions(source(), "1 hour", "3650 days"), "seen", "complete")
    assert seen.agg(F.sum("n")).first()[0] == events.count()
    twice = source().unionByName(source())
    assert run(stream.distinct_events(twice, "3650 days"), "once", "append").count() == events.count()
