"""Lempel-Ziv phrase fingerprints: the phrases that a text's own dictionary grows by, hashed, least hashes kept."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, powers, text_slices, tidy

#: Least hashes that a fingerprint keeps; a text of fewer phrases keeps them all.
KEPT = 128
#: Ids a range, about, that are looked at to cut ranges; where they are cut doesn't change results.
SAMPLED = 64


def phrases(text: str, at: int = 0, seen: set[str] | None = None, cut: int | None = None) -> tuple[list[int], int]:
    """Where the phrases of text[at:] start, and the end of the last, given the phrases seen before at.

    A phrase is the shortest run that isn't in the dictionary yet, which holds every shorter start of it; so the
    length of the last phrase is a good first guess. With cut, only phrases that end there or before are taken."""
    seen = set() if seen is None else seen
    n, size, starts = len(text) if cut is None else cut, 1, []
    add, append = seen.add, starts.append
    while at < n:
        end = at + size
        if end > n:
            end = n
        phrase = text[at:end]
        if phrase in seen:
            while end < n:
                end += 1
                phrase = text[at:end]
                if phrase not in seen:
                    break
            else:
                break  # what is left is known: no new phrase
        else:
            while size > 1 and (shorter := text[at : end - 1]) and shorter not in seen:
                phrase, end = shorter, end - 1
        add(phrase)
        append(at)
        size, at = end - at, end
    return starts, at


def signature(text: str, starts: list[int], end: int) -> np.ndarray:
    """The least 32-bit hashes of the phrases, ascending."""
    if not starts:
        return np.zeros(0, np.uint32)
    points = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    pw, inverse = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * pw[: len(points)], out=sums[1:])
    a = np.array(starts)
    b = np.append(a[1:], end)
    hashes = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:KEPT]


def parse(text: str, cut: int) -> tuple[list[int], int, int, set[str]]:
    """Phrase starts and end of a text; how many phrases end at cut or before, and which."""
    seen: set[str] = set()
    starts, at = phrases(text, 0, seen, cut)
    kept = seen.copy()
    more, end = phrases(text, at, seen)
    return starts + more, end, len(starts), kept


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard likeness of two phrase sets from their least hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.append(True, ~twice)
    least = both[distinct][:KEPT]
    return float(np.count_nonzero(both[1:][twice] <= least[-1]) / len(least))


def _compare(doc_id: int | None, text: str, nxt: str, own: tuple) -> tuple[tuple, tuple]:
    """A result row of a document, and what was parsed of the next one."""
    starts, end, inside, signed, seen = own
    n = len(text)
    keep = n - n // 2
    edited = text[:keep] + nxt[: n // 2]
    at = starts[inside] if inside < len(starts) else end
    more, edited_end = phrases(edited, at, seen)
    edited_signed = signature(edited, starts[:inside] + more, edited_end)
    following = _parsed(nxt)
    row = (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), signed.astype(">u4").tobytes().hex(), edited_signed.astype(">u4").tobytes().hex(), likeness(signed, edited_signed), likeness(signed, following[3]))
    return row, following


def fingerprinted(text: str) -> tuple[list[int], int, int, np.ndarray]:
    return _parsed(text)[:4]


def _parsed(text: str) -> tuple[list[int], int, int, np.ndarray, set[str]]:
    starts, end, inside, kept = parse(text, len(text) - len(text) // 2)
    return starts, end, inside, signature(text, starts, end), kept


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def next_to_each_other(docs: DataFrame) -> DataFrame:
    """doc_id, text and last, dealt so that a task holds neighbours in order: descending doc_id, null last, rows of
    one id by a hash of their text. The row behind a task's last comes along, marked last.

    Ranges are cut at ids of a sample, as longs; an id that fills more than a range, or null ids, are cut on by the hash
    of the text. Only about SAMPLED ids a range, counts and the first row's key of each range reach the driver, and what
    is broadcast is bounded by the number of ranges; texts are shuffled once. Rows equal in id and text follow each other in one range, through
    which texts stream."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions(spark)
    known = rows.select("doc_id").where("doc_id IS NOT NULL")
    ids = sorted(r[0] for r in known.sample(min(1.0, SAMPLED * parts / max(1, known.count())), seed=1).collect())
    cuts = sorted({ids[len(ids) * i // parts] for i in range(1, parts)}) if ids else []
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<bigint>")
    # How many cuts a row's id doesn't exceed, null ids last; a range's greatest id is its cut, which comes first and is
    # the one that can fill it. Both are read off once a row, in a function of that number.
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("doc_id")))).cast("int")
    full = lambda p: F.col("doc_id").isNull() | F.coalesce(F.get(bounds, F.lit(len(cuts)) - p) == F.col("doc_id"), F.lit(False))
    sizes = rows.select(F.explode(F.transform(F.array(place), lambda p: F.struct(p.alias("place"), full(p).alias("full")))).alias("s")).select("s.*").groupBy("place", "full").count().collect()
    share = max(1, sum(r["count"] for r in sizes) / parts)
    split, offsets, n = [1] * (len(cuts) + 2), [], 0
    for r in sizes:
        if r["full"]:
            split[r["place"]] = max(1, min(2 * parts, math.ceil(r["count"] / share)))
    for m in split:
        offsets.append(n)
        n += m + 1
    first, pieces = F.array(*[F.lit(x) for x in offsets]), F.array(*[F.lit(x) for x in split])
    deep = lambda m: F.least(F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * m).cast("int"), m - 1)
    part = F.get(F.transform(F.array(place), lambda p: F.get(first, p) + F.when(full(p), deep(F.get(pieces, p))).otherwise(F.get(pieces, p))), F.lit(0))
    keyed = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_part", part)
    firsts = keyed.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("empty"), F.bitwise_not("doc_id").alias("down"), F.col("_tie").alias("tie"))).alias("f"))
    found = sorted((r["_part"], ~r["f"]["down"] if r["f"]["down"] is not None else None, r["f"]["tie"]) for r in firsts.collect())
    heads = [(found[i - 1][0], doc_id, tie) for i, (_, doc_id, tie) in enumerate(found)]
    heads_df = spark.createDataFrame(heads, "_to int, _id long, _t long")
    last = keyed.join(F.broadcast(heads_df), keyed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))).dropDuplicates(["_to"])
    both = keyed.withColumn("last", F.lit(False)).select("_part", "last", "doc_id", "_tie", "text").unionByName(last.select(F.col("_to").alias("_part"), F.lit(True).alias("last"), "doc_id", "_tie", "text"))
    dealt = both.repartitionById(n, F.col("_part"))
    return dealt.sortWithinPartitions("_part", "last", F.col("doc_id").desc_nulls_last(), "_tie").select("doc_id", "text", "last")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no phrases and an empty
    fingerprint; two empty fingerprints are alike. The edited text is the first half and, in place of the last
    floor(n / 2) code points, the first as many of the next document; the last document's next is the first, and a
    single document is its own. Equal texts have equal fingerprints. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the document that waits for its next one
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for doc_id, text, last in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["last"].to_pylist()):
                    if last and before is None:
                        continue  # more rows with the key of the next range's first
                    if before is None:
                        before = doc_id, text, _parsed(text)
                        continue
                    row, following = _compare(*before[:2], text, before[2])
                    out.append(row)
                    before = None if last else (doc_id, text, following)
                if out:
                    yield pa.record_batch([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*out))], names=COLUMNS)

    return next_to_each_other(docs).mapInArrow(tidy(run), SCHEMA)
