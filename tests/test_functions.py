"""Golden vectors of the normalisers; each is a fixed point on its own results."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import dates, pay, places, scores
from lodestack.functions import text as T
from lodestack.functions.html import closed_references, structured_text
from lodestack.operators import identity
from lodestack.plans import normalizers as N


def apply(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["r"] for r in rows.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


MORE_PLACES = [
    ("IRL Menlo Park, CA - unknown days", "IRL Menlo Park, CA - unknown days"), ("Hybrid New York, 2-3 days per week in office", "IRL NYC - 2-3 days"),
    ("NYC/SF - 2-3 days", "IRL NYC - 2-3 days (or SF hub, 2-3 days)"), ("Remote-first, home base anywhere in the US", "Remote"), ("Austin or SF hub - 2 days", "IRL SF/Austin - 2 days"),
    ("Remote, US (in-office 1-2x/quarter; SF office option, not required)", "Remote (US; in-office 1-2x/quarter; SF office option, not required)"),
    ("Austin, New York City, San Francisco Bay Area, or Washington DC - 2 days per week", "IRL NYC - 2 days (or SF/Austin/DC hub, 2 days)"), ("Hybrid: NYC", "IRL NYC - unknown days"),
    (None, "Unknown"), ("remote-friendly", "Unknown"), ("SF full-time onsite", "IRL SF - 5 days"),
]


def test_places(spark):
    f = lambda c: places.normalize_location(c, N.PLACE)
    cases = [(a, b) for a, b, _ in N.LOCATIONS] + MORE_PLACES
    got = apply(spark, f, [a for a, _ in cases])
    assert got == [b for _, b in cases]
    assert apply(spark, f, got) == got


def test_pay(spark):
    got = apply(spark, pay.normalize_range, [a for a, *_ in N.RANGES])
    assert got == [b for _, b, _ in N.RANGES]
    assert apply(spark, pay.normalize_range, got) == got
    assert apply(spark, pay.envelope, ["$60/hour - $80/hour", "$236K – $296K · $213K – $266K", "A: $150K vs B: $170K", "$9K"]) == ["", "213-296", "150-170", ""]


def test_names(spark):
    for f, cases in ((scores.role_name, N.ROLES), (scores.normalize_lane, N.LANES), (scores.normalize_status, N.STATES)):
        got = apply(spark, f, [a for a, _ in cases])
        assert got == [b for _, b in cases]
        assert apply(spark, f, got) == got


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (dates.posting_date, ["1782932070272", "2026-02-30", "true", None], ["2026-07-01", None, None, None]),
        (dates.capture_date, ["June 13, 2026", "2026-06-13", "soon", None], ["2026-06-13", "2026-06-13", "", ""]),
        (dates.human_date, ["2026-06-13", "soon"], ["June 13, 2026", "soon"]),
        (identity.normalize_url, ["HTTPS://www.Example.com/a/b/?utm_source=x&b=2&a=1&ref=z#frag", "https://a.com"], ["https://example.com/a/b?a=1&b=2", "https://a.com/"]),
        (identity.company_from_domain, ["https://careers.airbnb.com/x", "https://www.linkedin.com/jobs", "https://example.co.uk/", "https://google.com/about/careers/x"], ["Airbnb", None, "Example", "Google"]),
        (identity.apply_url, ["https://jobs.ashbyhq.com/acme/fa0a5d05?src=LinkedIn", "https://jobs.lever.co/a/x/apply"], ["https://jobs.ashbyhq.com/acme/fa0a5d05/application", "https://jobs.lever.co/a/x/apply"]),
        (identity.workday_endpoint, ["https://acme.wd1.myworkdayjobs.com/WG/job/New-York-NY/Product-Lead_JR101195?source=LinkedIn", "https://acme.wd1.myworkdayjobs.com/WG"], ["https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/WG/job/New-York-NY/Product-Lead_JR101195", None]),
        (T.slug, ["Product Management &amp; Innovation", "", None, "--A--"], ["product-management-innovation", "job", "job", "a"]),
        (T.smarten, ['"a" it\'s'], ["“a” it’s"]),
        (T.repair_fusion, ["orNew and Old"], ["or New and Old"]),
        (T.strip_html, ["<p>a &amp; b</p><script>x</script><ul><li>c</li></ul>", None], ["a & b\n- c", ""]),
        (scores.completeness_category, ["✓ complete", "⚠ comp not verified", "comp not posted"], ["complete", "attention", "benign"]),
    ],
)
def test_columns(spark, f, given, expected):
    assert apply(spark, f, given) == expected


def test_capital_of_one_letter(spark):
    assert apply(spark, T.upper_letter, ["ß", "é", "ŉ", "ᾀ", "x", "", None]) == ["ẞ", "É", "ŉ", "ᾈ", "X", "", None]
    assert apply(spark, T.repair_fusion, ["éorNew xorNew _ofNew (orNew"]) == ["éor New xorNew _ofNew (or New"]


def test_open_references_stay(spark):
    given = ["<p>a&amp;b&amp</p>", "<p>&lt;x&gt &#39;&#39 R&D</p>", None]
    assert apply(spark, lambda c: structured_text(closed_references(c)), given) == ["a&b&amp", "<x&gt '&#39 R&D", ""]


@pytest.mark.parametrize(
    ("f", "most"),
    [
        (identity.declared_name, 20_000), (lambda c: places.location_color(places.normalize_location(c, N.PLACE), N.PLACE), 40_000),
        (lambda c: T.prettify_slug(T.prettify_slug(T.prettify_slug(c))), 5_000), (lambda c: identity.route(T.prettify_slug(c)), 8_000),
    ],
)
def test_what_is_used_again_is_computed_once(spark, f, most):
    rows = spark.createDataFrame([("x",)], "t string").select(f(F.col("t")).alias("r"))
    assert len(rows._jdf.queryExecution().analyzed().toString()) < most


def test_oxford_join(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "a array<string>")
    assert [r[0] for r in rows.select(T.oxford_join("a")).collect()] == ["", "a", "a and b", "a, b, and c"]
