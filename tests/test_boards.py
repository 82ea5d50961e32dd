"""Boards by domain and markup, the guard of titles, and feeds read through a filter of fixed size."""

from pyspark.sql import functions as F

from lodestack.operators import boards

DOMAINS = {
    "https://careers.airbnb.com/positions/8044715": ["airbnb"], "https://www.pinterestcareers.com/x": ["pinterestcareers", "pinterest"], "https://stripe-jobs.com/": ["stripe-jobs", "stripejobs", "stripe"],
    "https://onepeloton.com/1": ["onepeloton", "peloton"], "https://getanswersnow.com": ["getanswersnow", "answersnow"], "https://jobs.joinhandshake.com/a": ["joinhandshake", "handshake"], "": [], None: [], "not an address": [],
}
MARKUP = {
    '<iframe src="https://boards.greenhouse.io/embed/job_app?for=Acme&amp;token=1">': ["acme"], '<a href="https://job-boards.greenhouse.io/beta-co/jobs/1"> https://boards-api.greenhouse.io/v1/boards/gamma': ["beta-co"],
    '<script src="//boards.greenhouse.io/embed/job_board/js?x=1&for=delta"></script> ?for=delta ?for=epsilon': ["delta", "epsilon"], "<p>greenhouse</p>": [], None: [],
}


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f("v")).orderBy("i").collect()]


def test_candidates(spark):
    assert column(spark, DOMAINS, boards.domain_boards) == list(DOMAINS.values())
    assert column(spark, MARKUP, boards.markup_boards) == list(MARKUP.values())
    ids = {"https://a.b/positions/123456-x/12345678": "12345678", "https://a.b/?gh_jid=54321": "54321", "https://a.b/12345": None, None: None}
    assert column(spark, ids, lambda c: boards.embedded_id(c, F.lit(None).cast("string"))) == list(ids.values())


def test_a_guess_needs_its_title(spark):
    """The wrong board with the same number is refused; the markup's board is believed; texts may support a title."""
    pages = [
        (1, "https://acme.com/1234567", "Data Analyst | Acme", "", "", ), (2, "https://acme.com/1234567", "Driver", "", "We need a chef, data at hand"), (3, "https://other.com/1234567", None, '<a href="https://boards.greenhouse.io/acme/">', None),
        (4, "https://acme.com/1234567", None, None, "A data analyst works here."), (5, "https://acme.com/none", "Data Analyst", "", ""), (None, "https://acme.com/1234567", "Data Analyst", "", ""),
    ]
    known = spark.createDataFrame([("acme", 1234567, "Data Analyst"), ("acme", 1, "x"), (None, 1234567, "Data Analyst")], "board string, job_id long, title string")
    found = boards.recover(spark.createDataFrame(pages, "k int, url string, title string, html string, text string"), known, "k").collect()
    assert sorted((r["k"], r["board"], r["sure"]) for r in found) == [(1, "acme", False), (3, "acme", True), (4, "acme", False)]


def test_feeds_are_filtered(spark):
    """No entry that is asked for is lost, nearly all others go before any shuffle, and the filter is broadcast."""
    entries = spark.range(50_000).selectExpr("concat('id', id) AS v")
    held = boards.hash_filter(entries.where("v LIKE 'id777%'"), "v")
    kept = boards.may_hold(entries, "v", held)
    values = {r["v"] for r in kept.collect()}
    wanted = {r["v"] for r in entries.where("v LIKE 'id777%'").collect()}
    assert wanted <= values and len(values) < len(wanted) + 50 and held.count() <= boards.BITS // boards.ROW_BITS
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().toString()
    nothing = boards.may_hold(entries, "v", boards.hash_filter(entries.where("v IS NULL"), "v"))
    assert nothing.count() == 0


def test_odd_feeds(spark):
    feeds = spark.createDataFrame([("a", '{"jobs": [{"id": "0A0B0C0D-0000-0000-0000-000000000001", "title": "B"}, {"id": "0a0b0c0d-0000-0000-0000-000000000001", "title": "A"}, {"id": null}]}'), ("b", "no json"), ("c", None)], "org string, body string")
    urls = [(1, "https://jobs.ashbyhq.com/a/0a0b0C0D-0000-0000-0000-000000000001/application"), (2, "https://jobs.ashbyhq.com/a"), (3, None), (4, "https://jobs.ashbyhq.com/b/0a0b0c0d-0000-0000-0000-000000000001")]
    found = boards.feed_lookup(spark.createDataFrame(urls, "k int, url string"), feeds, "k").collect()
    assert [tuple(r) for r in found] == [(1, "a", "0a0b0c0d-0000-0000-0000-000000000001", "A")]


def test_exploded_sides_are_dealt_out(spark):
    postings = spark.createDataFrame([(1, "https://x.org/acme/0b9e1c2d-1111-2222-3333-444455556666")], "id int, url string")
    feeds = spark.createDataFrame([("acme", '{"jobs":[{"id":"0B9E1C2D-1111-2222-3333-444455556666","title":"PM"}]}')], "org string, body string")
    found = boards.feed_lookup(postings, feeds, "id")
    assert [tuple(r) for r in found.collect()] == [(1, "acme", "0b9e1c2d-1111-2222-3333-444455556666", "PM")]
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([(1, "https://www.acme.com/jobs?gh_jid=1234567", "PM", "", "")], "id int, url string, title string, html string, text string")
    each = spark.createDataFrame([("acme", 1234567, "PM")], "board string, job_id long, title string")
    assert "SortMergeJoin" in boards.recover(pages, each, "id")._jdf.queryExecution().executedPlan().toString()
