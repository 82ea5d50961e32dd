"""Postings behind employers' own pages: boards guessed from markup and address, and lookups in whole feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import bound, col, filled, strings

# What companies put around their brand in a domain, labels that are no brand, segments that are no board.
BRAND_ENDS = ["careers", "career", "jobs", "job", "hiring", "talent", "people", "hr", "recruiting", "work", "hq"]
BRAND_BEGINS = ["one", "get", "join", "try", "my", "the", "go", "we", "hey", "use"]
GENERIC = ["careers", "career", "jobs", "job", "www", "apply", "boards", "board", "work", "hire", "hiring", "talent", "recruiting", "join", "com", "org", "net", "io", "co", "ai", "app", "inc"]
NO_BOARDS = ["embed", "v1", "job_app"]
NAME = "[A-Za-z0-9][A-Za-z0-9_-]+"
#: Bits of the filter that a feed is read through, and bits of one row of it; the filter has 2 MB at most.
BITS, ROW_BITS = 1 << 24, 1 << 15


def variants(label: Column) -> Column:
    """A label of a domain and what its brand may be called: without hyphens, endings and beginnings."""
    cut = lambda ends, f: lambda both: F.flatten(F.transform(strings(ends), lambda e: F.transform(both, lambda b: f(b, e))))
    without_end = lambda b, e: F.when(F.endswith(b, e) & (F.length(b) > F.length(e) + 2), F.rtrim(F.substring(b, F.lit(1), F.length(b) - F.length(e)), F.lit("-")))
    without_begin = lambda b, e: F.when(F.startswith(b, e) & (F.length(b) > F.length(e) + 3), F.ltrim(F.substring(b, F.length(e) + 1, F.length(b)), F.lit("-")))
    every = lambda both: F.concat(both, cut(BRAND_ENDS, without_end)(both), cut(BRAND_BEGINS, without_begin)(both))
    both = F.array_distinct(F.array(label, F.replace(label, F.lit("-"), F.lit(""))))
    return F.filter(F.array_distinct(F.array_compact(bound(both, every))), lambda x: x != "")


def domain_boards(url) -> Column:
    """Names that a board may have by an address's host, likeliest first."""
    host = F.replace(F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit(""))), F.lit("www."), F.lit(""))
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    ahead = lambda own: F.array_distinct(F.concat(F.when(F.size(own) >= 2, F.slice(own, F.size(own) - 1, 1)).otherwise(strings([])), own))
    every = F.flatten(F.transform(bound(labels, ahead), variants))
    return F.filter(F.array_distinct(every), lambda x: ~F.array_contains(strings(GENERIC), x))


def markup_boards(html) -> Column:
    """Boards that a page's markup names: in addresses of boards, in the `for` of embedded ones."""
    text = F.coalesce(col(html), F.lit(""))
    named = rf"[?&]for=({NAME})"
    paths = F.regexp_extract_all(text, F.lit(r"""boards(?:-api)?[.]greenhouse[.]io/([^\s"'<>]*)"""))
    own = F.transform(paths, lambda p: F.when(p.startswith("embed/"), F.regexp_extract(p, named, 1)).otherwise(F.regexp_extract(p, rf"^({NAME})", 1)))
    found = F.array_distinct(F.transform(F.concat(own, F.regexp_extract_all(text, F.lit(named))), F.lower))
    return F.filter(found, lambda x: (x != "") & ~F.array_contains(strings(NO_BOARDS), x))


def embedded_id(url, html) -> Column:
    """The number of the posting: gh_jid of address or markup, else the longest run of six digits or more in the path."""
    given = lambda c: filled(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"gh_jid=(\d{5,})", 1))
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    runs = F.transform(F.regexp_extract_all(path, F.lit(r"(\d{6,})")), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.coalesce(given(url), given(html), F.array_min(runs)["x"])


def title_words(title) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(title), F.lit(""))), "[^a-z0-9+#]+"), lambda w: (w != "") & ~F.array_contains(strings(vocab.TITLE_STOP), w)))


def same_title(a: Column, b: Column) -> Column:
    """Two sets of words of titles share two, or all of a shorter one."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= F.least(F.lit(2), F.size(a), F.size(b)))


def recover(pages: DataFrame, boards: DataFrame, key: str) -> DataFrame:
    """(key, board, job_id, title, sure): the first board among a page's candidates that has its posting.

    pages needs key, url, title, html and text; boards needs board, job_id and title. Boards that the markup names come
    first and are believed (sure); a guess from the domain counts only if its title is the page's, or all of its words
    stand in the page's text. Candidates meet boards by name and number; texts join only those hits that their title
    leaves open. Pages without a number, and rows with a null key, find none."""
    both = bound(markup_boards("html"), lambda named: F.struct(F.size(named).alias("_named"), F.array_distinct(F.concat(named, domain_boards("url"))).alias("_boards")))
    asked = pages.select(key, embedded_id("url", "html").alias("job_id"), title_words("title").alias("_words"), both.alias("_b")).select(key, "job_id", "_words", "_b._named", "_b._boards")
    each = asked.where(F.col(key).isNotNull() & F.col("job_id").isNotNull()).select(key, "job_id", "_words", "_named", F.posexplode("_boards").alias("_rank", "board"))
    held = boards.select("board", F.col("job_id").cast("string").alias("job_id"), "title")
    # dealt out: rows that are exploded are judged by their size before, and would be sent whole through the driver
    found = each.join(held.hint("merge"), ["board", "job_id"])
    found = found.withColumn("sure", F.col("_rank") < F.col("_named")).withColumn("_good", F.col("sure") | same_title(F.col("_words"), title_words("title")))
    open_ones = found.where("NOT _good").join(pages.select(key, F.col("text").alias("_text")), key)
    lower = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("_text", F.lit(""))), "[^a-z0-9+#]+", " "), F.lit(" "))
    told = open_ones.where((F.size(title_words("title")) > 0) & F.forall(title_words("title"), lambda w: F.contains(lower, F.concat(F.lit(" "), w, F.lit(" ")))))
    columns = [key, "_rank", "board", "job_id", "title", "sure"]
    every = found.where("_good").select(*columns).unionByName(told.select(*columns))
    best = every.groupBy(key).agg(F.min(F.struct("_rank", "board", "job_id", "title", "sure")).alias("b"))
    return best.select(key, "b.board", "b.job_id", "b.title", "b.sure")


def _place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def hash_filter(values: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): which hashes the values have, as bitmaps of ROW_BITS; BITS / ROW_BITS rows at most, whatever their number."""
    at = values.where(F.col(column).isNotNull()).select(_place(F.col(column)).alias("h"))
    return at.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))


def may_hold(rows: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """rows whose value may be among those of a hash filter; the filter has a fixed size and is broadcast."""
    placed = rows.withColumn("_h", _place(F.col(column)))
    near = placed.join(F.broadcast(held), F.bitmap_bucket_number("_h") == F.col("_bucket"))
    at = F.bitmap_bit_position("_h")
    byte = F.ascii(F.decode(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return near.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0).drop("_bucket", "_bits", "_h")


def feed_lookup(postings: DataFrame, feeds: DataFrame, key: str) -> DataFrame:
    """(key, org, posting_id, title): the postings of addresses, in the whole feeds of their boards.

    postings needs key and url: the first part of a path is the board, the first part that is a UUID, in any case, the
    posting; addresses without one find nothing. feeds needs org and body, JSON with jobs of id and title. Each feed is
    exploded once, where it lies; only entries whose id may be asked for are shuffled. Of entries of one id in a feed
    the least title counts."""
    uuid = r"(?i)([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})"
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit(""))
    asked = postings.select(key, F.regexp_extract(path, "^/+([^/]+)", 1).alias("org"), F.lower(filled(F.regexp_extract("url", uuid, 1))).alias("posting_id")).where("posting_id IS NOT NULL AND org <> ''")
    jobs = F.from_json("body", "jobs array<struct<id:string,title:string>>")["jobs"]
    entries = feeds.select("org", F.explode(jobs).alias("j")).select("org", F.lower("j.id").alias("posting_id"), F.col("j.title").alias("title"))
    near = may_hold(entries, "posting_id", hash_filter(asked, "posting_id"))
    return asked.join(near.hint("merge"), ["org", "posting_id"]).groupBy(key, "org", "posting_id").agg(F.min("title").alias("title"))
