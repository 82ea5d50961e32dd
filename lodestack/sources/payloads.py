"""Postings from the JSON that tracking systems answer with: one parser a system, all with the same columns.

Each takes rows of (url, body) and gives url, source, posting_id, title, company, location, employment_type, remote,
compensation, apply_url, posted_date, text. A body that isn't the system's JSON gives nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import posting_date
from ..functions.html import structured_text
from ..functions.text import first, has, prettify_slug, strip, strip_html, strings
from ..operators.identity import part

COLUMNS = ["url", "source", "posting_id", "title", "company", "location", "employment_type", "remote", "compensation", "apply_url", "posted_date", "text"]

ASHBY = """id string, title string, employmentType string, location string, publishedAt string, isRemote boolean, workplaceType string, applyUrl string, jobUrl string,
 descriptionHtml string, descriptionPlain string, secondaryLocations array<struct<location:string>>,
 compensation struct<compensationTierSummary:string,compensationTiers:array<struct<title:string,tierSummary:string,components:array<struct<summary:string,compensationType:string,minValue:bigint,maxValue:bigint,currencyCode:string,interval:string>>>>>"""
GREENHOUSE = """id bigint, title string, absolute_url string, content string, location struct<name:string>, offices array<struct<name:string>>, first_published string, updated_at string,
 pay_input_ranges array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>,
 questions array<struct<label:string,description:string,required:boolean,fields:array<struct<name:string,type:string,values:array<struct<label:string>>>>>>"""
LEVER = """text string, categories struct<commitment:string,location:string,team:string,allLocations:array<string>>, createdAt bigint, description string,
 lists array<struct<text:string,content:string>>, additional string, salaryRange struct<min:bigint,max:bigint,currency:string,interval:string>, workplaceType string, applyUrl string, hostedUrl string"""
RIPPLING = """uuid string, name string, description struct<company:string,role:string>, workLocations array<string>, employmentType struct<label:string,id:string>, createdOn string,
 payRangeDetails array<struct<location:string,currency:string,frequency:string,rangeStart:double,rangeEnd:double,isRemote:boolean>>"""
WORKABLE = """shortcode string, title string, remote boolean, location struct<city:string,region:string,country:string>, workplace string, type string, published string,
 locations array<struct<city:string,region:string,country:string,hidden:boolean>>, description string, requirements string, benefits string"""
WORKDAY = """jobPostingInfo struct<title:string,jobDescription:string,location:string,postedOn:string,startDate:string,timeType:string,jobReqId:string,externalUrl:string,jobRequisitionLocation:struct<descriptor:string>>,
 hiringOrganization struct<name:string>"""
JSON_LD = """`@type` string, title string, datePosted string, employmentType string, jobLocationType string, hiringOrganization struct<name:string>, description string,
 jobLocation struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double,unitText:string>>"""


def _made(rows: DataFrame, source: str, **own: Column) -> DataFrame:
    cells = {"source": F.lit(source), "url": F.col("url")} | own
    return rows.select(*[cells.get(c, F.lit(None).cast("boolean" if c == "remote" else "string")).alias(c) for c in COLUMNS])


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("j", F.from_json("body", schema))


def _org(n: int = 0) -> Column:
    return prettify_slug(F.get(F.filter(F.split(part("url", 3), "/"), lambda p: p != ""), F.lit(n)))


def _once(values: Column, sep: str) -> Column:
    kept = F.array_distinct(F.filter(F.transform(values, lambda v: strip(v)), lambda v: v != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def _money(lo: Column, hi: Column, currency: Column) -> Column:
    whole = lambda c: F.format_number(c.cast("double"), 0)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.coalesce(currency, F.lit("USD")), F.lit(" "), whole(lo), F.lit("–"), whole(hi)))


def ashby(rows: DataFrame) -> DataFrame:
    """Salary tiers are pay; equity and bonuses aren't. Primary and further places in order, each once."""
    j = F.col("j")
    salary = lambda c: F.lower(c["compensationType"]).contains("salary")
    tier = lambda t: F.array_join(F.transform(F.filter(F.coalesce(t["components"], F.array()), salary), lambda c: c["summary"]), ", ")
    tiers = F.transform(F.coalesce(j["compensation"]["compensationTiers"], F.array()), tier)
    places = F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["location"]), strings([])))
    kind = F.regexp_replace(j["employmentType"], "(?<=[a-z])(?=[A-Z])", " ")
    return _made(
        _parsed(rows, ASHBY), "ashby", posting_id=j["id"], title=j["title"], company=_org(), location=_once(F.filter(places, lambda p: p.isNotNull()), "; "), employment_type=kind,
        remote=j["isRemote"], compensation=_once(tiers, " · "), apply_url=F.coalesce(j["applyUrl"], j["jobUrl"]), posted_date=posting_date(j["publishedAt"]), text=F.coalesce(j["descriptionPlain"], structured_text(j["descriptionHtml"])),
    )


def greenhouse(rows: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Pay in cents becomes whole units; a board's display name, from (board, name), else its prettified token."""
    parsed = _parsed(rows, GREENHOUSE).withColumn("_board", F.lower(first(part("url", 3), r"^/(?:v1/boards/)?([^/]+)")))
    if boards is not None:
        parsed = parsed.join(boards.select(F.lower("board").alias("_board"), F.col("name").alias("_name")), "_board", "left")
    else:
        parsed = parsed.withColumn("_name", F.lit(None).cast("string"))
    j = F.col("j")
    pay = F.transform(F.coalesce(j["pay_input_ranges"], F.array()), lambda p: _money(F.floor(p["min_cents"] / 100), F.floor(p["max_cents"] / 100), p["currency_type"]))
    entities = F.regexp_replace(F.regexp_replace(F.regexp_replace(j["content"], "&lt;", "<"), "&gt;", ">"), "&quot;", '"')
    return _made(
        parsed, "greenhouse", posting_id=j["id"].cast("string"), title=j["title"], company=F.coalesce("_name", prettify_slug("_board")),
        location=F.coalesce(j["location"]["name"], _once(F.transform(j["offices"], lambda o: o["name"]), "; ")), compensation=_once(pay, " · "), apply_url=j["absolute_url"],
        posted_date=posting_date(j["first_published"]), text=structured_text(entities),
    )


def lever(rows: DataFrame) -> DataFrame:
    """Description, lists and closing text as one; createdAt in milliseconds."""
    j = F.col("j")
    lists = F.array_join(F.transform(F.coalesce(j["lists"], F.array()), lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n")
    pay = j["salaryRange"]
    return _made(
        _parsed(rows, LEVER), "lever", posting_id=first("url", r"([0-9a-f-]{36})"), title=j["text"], company=_org(), location=F.coalesce(_once(j["categories"]["allLocations"], "; "), j["categories"]["location"]),
        employment_type=j["categories"]["commitment"], remote=F.lower(j["workplaceType"]) == "remote", compensation=_money(pay["min"], pay["max"], pay["currency"]), apply_url=F.coalesce(j["applyUrl"], j["hostedUrl"]),
        posted_date=posting_date(j["createdAt"].cast("string")), text=structured_text(F.concat_ws("\n", j["description"], lists, j["additional"])),
    )


def rippling(rows: DataFrame) -> DataFrame:
    """Remote if all places are; label and id of the employment type stand the other way round."""
    j = F.col("j")
    away = lambda p: has(p, r"(?i)\bremote\b")
    pay = F.transform(F.coalesce(j["payRangeDetails"], F.array()), lambda p: F.concat_ws(": ", p["location"], _money(p["rangeStart"], p["rangeEnd"], p["currency"])))
    return _made(
        _parsed(rows, RIPPLING), "rippling", posting_id=j["uuid"], title=j["name"], company=_org(), location=_once(j["workLocations"], "; "), employment_type=F.coalesce(j["employmentType"]["id"], j["employmentType"]["label"]),
        remote=(F.size(j["workLocations"]) > 0) & F.forall(j["workLocations"], away), compensation=_once(pay, " · "), apply_url=F.concat(F.col("url"), F.lit("/apply")), posted_date=posting_date(j["createdOn"]),
        text=structured_text(F.concat_ws("\n", j["description"]["company"], j["description"]["role"])),
    )


def workable(rows: DataFrame) -> DataFrame:
    """Hidden places are dropped."""
    j = F.col("j")
    place = lambda p: F.array_join(F.filter(F.array(p["city"], p["region"], p["country"]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    seen = F.filter(F.coalesce(j["locations"], F.array()), lambda p: ~F.coalesce(p["hidden"], F.lit(False)))
    return _made(
        _parsed(rows, WORKABLE), "workable", posting_id=j["shortcode"], title=j["title"], company=_org(), location=F.coalesce(_once(F.transform(seen, place), "; "), place(j["location"])), employment_type=j["type"],
        remote=j["remote"], apply_url=F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/apply/")), posted_date=posting_date(j["published"]), text=structured_text(F.concat_ws("\n", j["description"], j["requirements"], j["benefits"])),
    )


def workday(rows: DataFrame) -> DataFrame:
    """A relative day of posting gives way to the start date."""
    i = F.col("j.jobPostingInfo")
    return _made(
        _parsed(rows, WORKDAY), "workday", posting_id=i["jobReqId"], title=i["title"], company=F.col("j.hiringOrganization.name"), location=F.coalesce(i["location"], i["jobRequisitionLocation"]["descriptor"]),
        employment_type=i["timeType"], apply_url=i["externalUrl"], posted_date=F.coalesce(posting_date(i["postedOn"]), posting_date(i["startDate"])), text=structured_text(i["jobDescription"]),
    )


def json_ld(pages: DataFrame) -> DataFrame:
    """The first posting among a page's JSON-LD blocks (objects, arrays, graphs) that says where, how or for how much."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    block = pages.select("url", F.posexplode(blocks).alias("p", "b"))
    nodes = F.when(strip("b").startswith("["), F.from_json("b", "array<string>")).otherwise(F.coalesce(F.from_json(F.get_json_object("b", "$.@graph"), "array<string>"), F.array("b")))
    node = block.select("url", "p", F.posexplode(nodes).alias("q", "n")).withColumn("j", F.from_json("n", JSON_LD)).where(F.col("j.`@type`") == "JobPosting")
    a, pay = F.col("j.jobLocation.address"), F.col("j.baseSalary")
    place = F.array_join(F.filter(F.array(a["addressLocality"], a["addressRegion"]), lambda x: x.isNotNull()), ", ")
    money = _money(pay["value"]["minValue"], pay["value"]["maxValue"], pay["currency"])
    says = F.coalesce(F.nullif(place, F.lit("")), F.col("j.employmentType"), money)
    best = node.where(says.isNotNull()).groupBy("url").agg(F.min_by("j", F.struct("p", "q")).alias("j"))
    return _made(
        best, "json-ld", title=F.col("j.title"), company=F.col("j.hiringOrganization.name"), location=F.nullif(place, F.lit("")), employment_type=F.col("j.employmentType"), remote=F.col("j.jobLocationType") == "TELECOMMUTE",
        compensation=money, posted_date=posting_date(F.col("j.datePosted")), text=structured_text(F.col("j.description")),
    )


def page(pages: DataFrame) -> DataFrame:
    """Any page: the title of og:title, first heading or title element, and its text."""
    inner = lambda tag: strip_html(first("html", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"))
    og = first("html", r'(?is)<meta[^>]*property=["\']og:title["\'][^>]*content=["\']([^"\']*)')
    title = F.coalesce(og, F.nullif(inner("h1"), F.lit("")), F.nullif(inner("h2"), F.lit("")), F.nullif(inner("title"), F.lit("")))
    return _made(pages, "generic", title=title, text=structured_text("html"))


def greenhouse_questions(rows: DataFrame) -> DataFrame:
    """(url, questions) of Greenhouse bodies in the shape that the question functions read."""
    def question(q: Column) -> Column:
        field = F.get(q["fields"], F.lit(0))
        return F.struct(q["label"].alias("label"), field["type"].alias("type"), F.transform(q["fields"], lambda f: f["name"]).alias("names"), F.transform(field["values"], lambda v: v["label"]).alias("options"), q["required"].alias("required"))

    return _parsed(rows, GREENHOUSE).select("url", F.transform(F.coalesce(F.col("j.questions"), F.array()), question).alias("questions"))


ADAPTERS = {"ashby": ashby, "greenhouse": greenhouse, "lever": lever, "rippling": rippling, "workable": workable, "workday": workday}


def postings(rows: DataFrame, route: Column) -> DataFrame:
    """Rows of (url, body), each by the adapter that route names, as one table; others are left out."""
    routed = rows.withColumn("_route", route)
    found = None
    for name, adapter in ADAPTERS.items():
        own = adapter(routed.where(F.col("_route") == name).drop("_route"))
        found = own if found is None else found.unionByName(own)
    return found


def linkedin(rows: DataFrame) -> DataFrame:
    """A guest fragment (url, html): title, company and place by their classes, pay by its element or a line of pay."""
    inner = lambda css: strip_html(first("html", rf'(?is)<(?:a|h1|h2|div|span)\b[^>]*class="[^"]*\b{css}\b[^"]*"[^>]*>(.*?)</(?:a|h1|h2|div|span)>'))
    given = lambda *css: F.coalesce(*[F.nullif(inner(c), F.lit("")) for c in css])
    text = structured_text(F.coalesce(first("html", r'(?is)<div\b[^>]*class="[^"]*show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>'), F.col("html")))
    line = first(text, r"(?im)^(.*(?:salary|compensation|base pay|pay range|annual)\b.*\$\s?\d{2,3}[,\d]*.*)$")
    day = posting_date(first("html", r'(?i)<time\b[^>]*datetime="([^"]+)"'))
    return _made(
        rows, "linkedin", posting_id=first("url", r"/jobs/view/(?:[^/?#]*?-)?(\d{6,})"), title=F.coalesce(given("top-card-layout__title", "topcard__title"), F.lit("Unknown Title")), company=F.coalesce(given("topcard__org-name-link", "topcard__flavor"), F.lit("LinkedIn")),
        location=given("topcard__flavor--bullet"), compensation=F.coalesce(given("compensation__salary", "compensation__salary-range"), F.substring(line, 1, 200)), apply_url=F.col("url"), posted_date=day, text=text,
    )


def first_board(candidates: DataFrame, boards: DataFrame) -> DataFrame:
    """(url, board) of the first of each address's candidates (url, boards, posting_id) that holds its posting."""
    one = candidates.select("url", "posting_id", F.posexplode("boards").alias("pos", "board"))
    held = one.join(boards.select("board", "posting_id").distinct(), ["board", "posting_id"], "left_semi")
    return held.groupBy("url").agg(F.min_by("board", "pos").alias("board"))


def best_text(parts: DataFrame, penalty: int = 500) -> DataFrame:
    """(url, selector, text) of the longest part of each page; a whole body must be longer by a penalty."""
    size = F.length("text") - F.when(F.col("selector") == "body", penalty).otherwise(0)
    return parts.groupBy("url").agg(F.max_by(F.struct("selector", "text"), F.struct(size, F.col("selector"))).alias("b")).select("url", "b.selector", "b.text")


def engine(attempts: DataFrame, name: str = "auto") -> DataFrame:
    """Attempts of an engine: auto takes all, others only their own and the tracking systems' answers."""
    return attempts if name == "auto" else attempts.where(F.col("method").isin(name, "ats"))
