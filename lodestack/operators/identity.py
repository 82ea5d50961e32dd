"""Identity of postings: keys of tracking systems, normalised addresses, employers by domain, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import bound, chain, col, filled, first, first_line, has, prettify_slug, slug, strings, strip, strip_html

UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"
SHAPE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url, n: int) -> Column:
    """1 scheme, 2 host (as written), 3 path, 4 query; empty where absent."""
    return F.regexp_extract(strip(url), SHAPE, n)


def host(url) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def ats_key(url) -> Column:
    """A posting's identity in a tracking system that its address shows, else null."""
    u = strip(url)
    h, path = F.lower(part(u, 2)), part(u, 3)
    steps = F.filter(F.split(path, "/"), lambda p: p != "")
    org, uuid = F.lower(F.get(steps, F.lit(0))), F.lower(first(u, UUID))
    board = F.lower(F.coalesce(first(u, r"[?&]for=([^&#]+)"), F.get(F.filter(steps, lambda p: ~p.isin("embed", "job_app", "jobs")), F.lit(0))))
    job = F.coalesce(first(path, r"/jobs/(\d+)"), first(u, r"[?&](?:gh_jid|token)=(\d+)"))
    linked = F.coalesce(first(u, r"/jobs/view/(?:[^/?#]*?-)?(\d{6,})"), first(u, r"[?&]currentJobId=(\d+)"))
    return (
        F.when(h.endswith("ashbyhq.com"), F.concat(F.lit("ashby:"), org, F.lit(":"), uuid))
        .when(h.endswith("greenhouse.io"), F.concat(F.lit("greenhouse:"), board, F.lit(":"), job))
        .when(F.contains(h, F.lit("lever.co")), F.concat(F.lit("lever:"), org, F.lit(":"), uuid))
        .when(F.contains(h, F.lit("linkedin.com")), F.concat(F.lit("linkedin:"), linked))
    )


def normalize_url(url) -> Column:
    """The key that all forms of an address share: its tracking-system key, else scheme and host in lower case without
    www, no fragment, no closing slash, no tracking parameters and the others sorted."""
    u = strip(url)
    pairs = F.filter(F.split(part(u, 4), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    kept = F.array_sort(F.filter(pairs, lambda p: ~name(p).startswith("utm_") & ~F.array_contains(strings(vocab.TRACKING), name(p))))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    scheme = F.when(part(u, 1) == "", "https").otherwise(F.lower(part(u, 1)))
    path = F.regexp_replace(part(u, 3), "/+$", "")
    plain = F.concat(scheme, F.lit("://"), host(u), F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.coalesce(ats_key(u), plain)


def company_from_domain(url) -> Column:
    """The employer that a host names; null for tracking systems and boards, unless on their own careers path."""
    labels = F.filter(F.split(host(url), r"\."), lambda p: p != "")
    last = F.get(labels, F.size(labels) - 2)
    label = F.when(F.array_contains(strings(vocab.SECOND_LEVEL), last) & (F.size(labels) >= 3), F.get(labels, F.size(labels) - 3)).otherwise(last)
    platform = F.array_contains(strings(vocab.ATS_HOSTS + vocab.BOARD_HOSTS), label) & ~has(part(url, 3), r"(?i)/careers(?:/|$)")
    return F.when((F.size(labels) >= 2) & ~F.array_contains(strings(vocab.DOMAIN_CHROME), label) & ~platform, prettify_slug(label))


def source_token(url) -> Column:
    label = F.get(F.split(host(url), r"\."), F.size(F.split(host(url), r"\.")) - 2)
    return F.when(F.array_contains(strings(vocab.ATS_HOSTS), label), label)


def brand_token(url) -> Column:
    """A domain's brand without what careers sites add to it."""
    labels = F.split(host(url), r"\.")
    label = F.get(labels, F.size(labels) - 2)
    return F.regexp_replace(label, "(?<=.)(careers|jobs|hq|inc)$", "")


def capture_key(url, apply_url=None, posting_id=None) -> Column:
    """The log's key: the address's or the application address's own, one recovered from an employer's address with a
    posting number, else the normalised address."""
    jid = F.lower(first(url, r"[?&]ashby_jid=" + UUID))
    number = F.coalesce(first(url, r"/positions/(\d{6,})"), first(url, r"[?&]gh_jid=(\d+)"), first(url, r"/jobs/apply/(\d{6,})"))
    if posting_id is not None:
        own = col(posting_id).cast("string")
        number = F.coalesce(number, F.when(own.rlike(r"^\d{6,}$"), own))
    token = brand_token(url)
    keys = [ats_key(url)] + ([ats_key(apply_url)] if apply_url is not None else [])
    return F.coalesce(*keys, F.concat(F.lit("ashby:"), token, F.lit(":"), jid), F.concat(F.lit("greenhouse:"), token, F.lit(":"), number), normalize_url(url))


#: Where a capture's body ends, here and in the captures of the reference.
END = r"=== JOB POST END ===|--- JOB TEXT END ---"
DETAIL = r"(?m)^(?:(?:Captured At|Application URL|Source|Posting ATS ID|Methods Checked|Additional Notes):\s*\S|Verification:)"


def written_key(text) -> Column:
    """The key of the posting that a written capture names, by its address before the end of the body, and the
    application address and posting id of the original details behind it, or of the latest ones where it has none."""
    pieces = F.split(F.coalesce(col(text), F.lit("")), END, 2)
    head, tail = F.get(pieces, F.lit(0)), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))
    url = F.coalesce(first(head, r"(?m)^Job Posting URL:[ \t]*(\S+)"), first(head, r"(?m)^(?:Source )?URL:[ \t]*(\S+)"))

    def details(name: str) -> Column:
        found = F.regexp_extract_all(tail, F.lit(rf"(?ms)^{name} CAPTURE DETAILS$(.*?)(?=^(?:ORIGINAL|LATEST) CAPTURE DETAILS$|\z)"), F.lit(1))
        return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))

    own = F.when(has(details("ORIGINAL"), DETAIL), details("ORIGINAL")).otherwise(details("LATEST"))

    def field(label: str) -> Column:
        value = strip(first(own, rf"(?m)^{label}:\s*(.*)$"))
        return F.when(~value.isin("", "Not Available"), value)

    return F.when(url.isNotNull(), capture_key(url, field("Application URL"), field("Posting ATS ID")))


def with_filenames(postings: DataFrame) -> DataFrame:
    """postings (pos, company, title, key, url) with filename: a later posting of another key under a taken name gets
    its tracking system's name, or six digits of its key's hash. A window a name; names are as many as postings."""
    base = F.concat(slug("company"), F.lit("__"), slug(first_line("title")))
    named = postings.withColumn("_base", base)
    owner = F.first("key").over(Window.partitionBy("_base").orderBy("pos"))
    suffix = F.coalesce(source_token("url"), F.substring(F.sha1("key"), 1, 6))
    return named.withColumn("filename", F.concat("_base", F.when(owner != F.col("key"), F.concat(F.lit("-"), suffix)).otherwise(""), F.lit(".txt"))).drop("_base")


def failed_filename(url, key) -> Column:
    return F.concat(slug(F.when(host(url) == "", "unknown").otherwise(host(url))), F.lit("__failed-"), F.substring(F.sha1(col(key)), 1, 6), F.lit(".txt"))


WRAPPED = [(r"(?i)^(?:careers?|jobs?)\s+at\s+", ""), (r"(?i)[\s|·]+(?:careers?|jobs?)$", ""), (r"^[ \t|·:,–—-]+|[ \t|·:,–—-]+$", "")]


def clean_company(name) -> Column:
    """A company without what careers pages put around it; a name of small letters that came out is capitalised."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def clean(raw: Column) -> Column:
        return bound(tidy(chain(raw, *(WRAPPED * 3))), lambda made: F.when((made != "") & (made != raw) & ~made.rlike("[A-Z]"), prettify_slug(made)).otherwise(made))

    return bound(tidy(F.coalesce(col(name), F.lit(""))), clean)


def title_and_brand(title) -> Column:
    """A title without its site's branding, and the employer that the branding names."""
    sep = r"\s*[|–—·-]\s*"
    at = rf"(?i)^(.+?){sep}(?:careers?|jobs?)\s+at\s+([^|–—·-]+?)\s*$"
    co = rf"(?i)^(.+?){sep}([^|–—·-]+?)\s+(?:careers?|jobs?)\s*$"
    bare = rf"(?i)^(.+?){sep}(?:careers?|jobs?)\s*$"

    def parted(s: Column) -> Column:
        found = F.coalesce(first(s, at), first(s, co), first(s, bare), s)
        brand = bound(clean_company(F.coalesce(first(s, at, 2), first(s, co, 2))), lambda b: F.when((b != "") & ~has(b, r"(?i)\b(careers?|jobs?)\b"), b))
        return F.struct(strip(found, r"\s|·:,–—-").alias("title"), brand.alias("brand"))

    return bound(F.trim(F.regexp_replace(F.coalesce(col(title), F.lit("")), r"\s+", " ")), parted)


def declared_name(html, organization=None) -> Column:
    """How an employer's page spells the employer: the organisation of its posting, its site's name, else what its title
    wraps around the role; null where it declares none."""
    plain = lambda c: F.trim(F.regexp_replace(strip_html(c), r"\s+", " "))
    own = [filled(plain(organization))] if organization is not None else []

    def declared(h: Column) -> Column:
        site = F.coalesce(first(h, r"""(?is)<meta[^>]*og:site_name["'][^>]*content=["']([^"']*)"""), first(h, r"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*og:site_name"""))
        title = plain(first(h, r"(?is)<title[^>]*>(.*?)</title>"))
        told = lambda t: F.coalesce(filled(plain(first(t, r"(?i)^(?:careers?|jobs?)\s+at\s+(.+)$"))), title_and_brand(t)["brand"])
        return F.coalesce(*own, filled(plain(site)), bound(title, told))

    return bound(col(html), declared)


def apply_url(url) -> Column:
    """Where to apply for a posting, by its system: the path alone, with the system's own ending."""
    u = strip(url)
    base = F.concat(F.when(part(u, 1) == "", "https").otherwise(part(u, 1)), F.lit("://"), part(u, 2))
    path = F.regexp_replace(part(u, 3), "/+$", "")
    once = lambda end: F.when(path.endswith(end), path).otherwise(F.concat(path, F.lit(end)))
    h = F.lower(part(u, 2))
    return (
        F.when(h.endswith("ashbyhq.com"), F.concat(base, once("/application"))).when(F.contains(h, F.lit("lever.co")), F.concat(base, once("/apply")))
        .when(h.endswith("workable.com"), F.concat(base, once("/apply"), F.lit("/"))).when(h.endswith("homerun.co"), F.concat(base, once("/apply")))
    )


def workday_endpoint(url) -> Column:
    """The JSON address of a Workday posting; null for boards and searches."""
    u = strip(url)
    tenant = first(part(u, 2), r"^([^.]+)\.[^.]+\.myworkdayjobs\.com$")
    path = F.regexp_replace(part(u, 3), r"^/[a-z]{2}-[A-Z]{2}(?=/)", "")
    site, rest = first(path, r"^/([^/]+)/job/.+$"), first(path, r"^/[^/]+(/job/.+?)/*$")
    return F.concat(F.lit("https://"), part(u, 2), F.lit("/wday/cxs/"), tenant, F.lit("/"), site, rest)


def route(url) -> Column:
    """The adapter that reads an address: by host, or by a parameter that names a posting; null for plain pages."""
    by_host = {"ashbyhq.com": "ashby", "greenhouse.io": "greenhouse", "lever.co": "lever", "rippling.com": "rippling", "workable.com": "workable", "myworkdayjobs.com": "workday", "linkedin.com": "linkedin"}

    def routed(h: Column) -> Column:
        out = F.when(F.lit(False), "")
        for suffix, name in by_host.items():
            out = out.when((h == suffix) | h.endswith("." + suffix), name)
        return out

    return bound(col(url), lambda u: F.coalesce(bound(F.lower(part(u, 2)), routed), F.when(has(part(u, 4), r"(?:^|&)ashby_jid="), "ashby_jid")))
