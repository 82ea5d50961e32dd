"""Personal data: fixed patterns for four kinds, and contexts learnt from them that reveal others.

What the fixed patterns find are the seeds. The one or two words before a seed, and the one behind it, are lexical
patterns. Patterns and what they stand at form a graph that Spark scores in rounds: a pattern by its instances, an
instance that the fixed patterns miss by its patterns. Instances of high score are seeds of the next round, in which
they induce patterns that no first seed had. Looser shapes at patterns of high score become spans as well."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_slices, tidy

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern must have, the score at which it or an instance counts as sure, and rounds.
SEEDS, SURE, ROUNDS = 3, 0.75, 4
#: Code points before a token that may hold its context, and that may stand between.
REACH, GAP = 60, 6

# The patterns of the four kinds, anchored so that each is tried once a run of its characters.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser shapes of the same kinds, only taken behind a sure pattern.
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+(?:@[A-Za-z0-9-]+|\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+)")),
    ("ip", re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")),
    ("card", re.compile(r"[0-9](?:[\x20.-]?[0-9]){12,18}")),
    ("phone", re.compile(r"\(?[0-9]{2,5}\)?(?:[\x20./-]?\(?[0-9]{2,5}\)?){1,5}")),
)
# Where looser shapes may begin, also inside a token: before what joins an address, at digits, at groups with colons.
AT = re.compile(r"@|\x20?[\[(]at[\])]")
DIGITS = re.compile(r"[0-9]++")
GROUPS = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{1,4}+:{1,2}[0-9A-Fa-f]")
HARD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From every @ to both sides: the run of local characters before it, no further than the last match, and labels."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            free = tail.end()
            found.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def base(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, leftmost and not overlapping; matches that fail their kind's test are dropped."""
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in own)


def behind(text: str, stop: int) -> list[str]:
    """The word behind a place, in lower case and marked; none where none is near."""
    m = WORD.search(text, stop, stop + REACH)
    return [f"> {m[0].lower()}"] if m and m.start() - stop <= GAP and m.end() < stop + REACH else []


def before(text: str, start: int) -> list[str]:
    """The one and the two words before a place, in lower case; none where no word is near."""
    left = text[max(0, start - REACH) : start]
    words = [(m.end(), m[0].lower()) for m in WORD.finditer(left)]
    if not words or len(left) - words[-1][0] > GAP:
        return []
    if max(0, start - REACH) > 0 and len(words) and WORD.match(left) and len(words) <= 2:
        words = words[1:]  # the first may be cut
    tail = [w for _, w in words[-2:]]
    return ([tail[-1]] if tail else []) + ([" ".join(tail)] if len(tail) == 2 else [])


def starts(text: str) -> list[tuple[int, set[str]]]:
    """Where looser shapes may begin, ascending, and the kinds to try there; never inside a number or a local part."""
    out: dict[int, set[str]] = {}
    for m in AT.finditer(text):
        a = m.start()
        while a and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.setdefault(a, set()).add("email")
    for m in DIGITS.finditer(text):
        a = m.start()
        if a < 2 or text[a - 1] not in "./-()" or not "0" <= text[a - 2] <= "9":
            out.setdefault(a, set()).update(("card", "phone"))
    if text.count(":") > 2:
        for m in GROUPS.finditer(text):
            out.setdefault(m.start(), set()).add("ip")
    return sorted(out.items())


def tokens(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[str, bool, int, int, str]]:
    """(kind, seed, start, end, instance) of what stands behind contexts: seeds, loose shapes, and '' for other
    tokens with a digit or @, which speak against a pattern."""
    out = [(kind, True, a, b, text[a:b]) for kind, own in zip(KINDS, spans) for a, b in own]
    taken: list[list[int]] = []  # what spans cover, ascending and apart
    for a, b in sorted((a, b) for own in spans for a, b in own):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    firsts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_left(firsts, b) - 1
        return i < 0 or taken[i][1] <= a

    loose, other = [], []
    at = 0
    for start, kinds in starts(text):
        if start < at:
            continue
        best = None
        for kind, shape in LOOSE:
            m = shape.match(text, start) if kind in kinds else None
            if m and free(*m.span()) and (best is None or m.end() > best[1].end()):
                n = len(digits_of(m[0]))
                if kind == "email" or kind == "ip" or kind == "phone" and 7 <= n <= 15 or kind == "card" and 13 <= n <= 19 and luhn(digits_of(m[0])):
                    best = kind, m
        if best:
            loose.append((best[0], False, *best[1].span(), best[1][0]))
            at = best[1].end()
    i = 0  # the first loose shape that doesn't end before the token
    for hard in HARD.finditer(text):
        while i < len(loose) and loose[i][3] <= hard.start():
            i += 1
        if (i == len(loose) or loose[i][2] >= hard.end()) and free(*hard.span()):
            other.append(("", False, *hard.span(), hard[0]))
    loose += other
    return out + loose


FOUND = "doc_id long, text_key binary, email array<int>, ip array<int>, card array<int>, phone array<int>, near array<struct<kind:string,seed:boolean,start:int,stop:int,instance:long,pattern:string>>"


def extract(docs: DataFrame) -> DataFrame:
    """What the fixed patterns find in each text, as starts and ends by turns, and the tokens behind contexts."""
    near_type = pa.list_(pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("pattern", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keys, spans, near = [], [], []
                for text in part["text"].to_pylist():
                    text = text or ""
                    keys.append(hashlib.md5(text.encode()).digest())
                    own = base(text)
                    spans.append(own)
                    rows = {}
                    for kind, seed, a, b, instance in tokens(text, own):
                        for p in before(text, a) + behind(text, b):
                            key = int.from_bytes(hashlib.blake2b(instance.encode(), digest_size=8).digest(), "big", signed=True)
                            if kind:
                                rows[kind, seed, a, b, key, p] = None
                            else:
                                rows[kind, seed, 0, 0, key, p] = None
                    near.append([dict(zip(("kind", "seed", "start", "stop", "instance", "pattern"), r)) for r in rows])
                flat = [pa.array([[x for span in s[k] for x in span] for s in spans], pa.list_(pa.int32())) for k in range(4)]
                yield pa.record_batch([part["doc_id"], pa.array(keys, pa.binary()), *flat, pa.array(near, near_type)], names=["doc_id", "text_key", *KINDS, "near"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), FOUND)


def sure_patterns(found: DataFrame, work: Workspace, seeds: int = SEEDS, sure: float = SURE, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern) of high-confidence patterns.

    Edges join patterns to different instances, so repeats and copies add nothing. A pattern's score for a kind is
    the sum of its instances' weights over the number of all that it stands at, tokens of no shape among them, and
    one. A seed weighs 1, a loose shape 1 less the product of what its patterns leave open. A pattern counts once it
    has enough sure instances: seeds in the first round, and later also what earlier rounds made sure, so instances
    induce new patterns. Sums are partial before each shuffle, so a common pattern is no hot key."""
    edges = work.table("edges", found.select(F.explode("near").alias("n")).select("n.pattern", "n.kind", "n.seed", "n.instance").distinct())
    shaped = edges.where("kind <> ''")
    able = shaped.select("pattern").distinct()
    totals = work.table("totals", edges.join(able, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n")))
    given = shaped.where("seed").select("pattern", "kind", "instance").distinct()
    loose = work.table("loose", shaped.where("NOT seed").join(given.select("kind", "instance").distinct(), ["kind", "instance"], "left_anti").select("pattern", "kind", "instance"))
    firm = given.groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("gain"), F.count("*").alias("sure"))
    support, scores = firm, None
    for i in range(rounds):
        known = support.groupBy("pattern", "kind").agg(F.sum("gain").alias("gain"), F.sum("sure").alias("sure")).where(F.col("sure") >= seeds)
        scores = work.table(f"scores{i}", known.join(totals, "pattern").select("pattern", "kind", (F.col("gain") / (F.col("n") + 1)).alias("score")))
        weights = loose.join(scores, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("weight"))
        gained = loose.join(weights, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("weight").alias("gain"), F.sum((F.col("weight") >= sure).cast("long")).alias("sure"))
        support = firm.unionByName(gained)
    return scores.where(F.col("score") >= sure).select("pattern", "kind")


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts by kind of all spans, base_sha256 of the fixed patterns' spans and all spans as text.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no spans. Added spans have one
    of the four kinds and never overlap a base span. Repeated rows give repeated results: added spans are found by
    id and text. An empty table gives no rows. Texts never leave their task; what is shuffled are contexts."""
    work = Workspace(docs.sparkSession, "pii")
    found = work.table("found", extract(docs))
    sure = sure_patterns(found, work, **how)
    loose = found.select("doc_id", "text_key", F.explode(F.filter("near", lambda n: (n["kind"] != "") & ~n["seed"])).alias("n")).select("doc_id", "text_key", "n.kind", "n.pattern", "n.start", "n.stop")
    added = loose.join(sure, ["pattern", "kind"], "left_semi").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "added")
    both = found.drop("near").join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def pairs(kind: str):
        own = F.transform(F.sequence(F.lit(0), F.size(kind) - 2, F.lit(2)), lambda i: F.struct(F.lit(kind).alias("kind"), F.get(kind, i).alias("start"), F.get(kind, i + 1).alias("stop")))
        return F.when(F.size(kind) > 0, own).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int>>"))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def is_kind(k: str):
        return lambda s: s["kind"] == k

    base_all, every = [pairs(k) for k in KINDS], []
    for k, own in zip(KINDS, base_all):
        more = F.coalesce(F.filter("added", is_kind(k)), F.array().cast("array<struct<kind:string,start:int,stop:int>>"))
        every.append(F.array_sort(F.concat(own, more)))
    counts = [F.size(e).cast("long").alias(f"n_{k}") for k, e in zip(KINDS, every)]
    return both.select("doc_id", *counts, F.sha2(text_of(F.concat(*base_all)), 256).alias("base_sha256"), text_of(F.concat(*every)).alias("spans"))
