"""Katz backoff: Good-Turing discounted bigram counts over a smoothed unigram base, exactly normalised.

Texts are read once into chunks: some thousand documents as one row of packed token numbers. A chunk asks the
partitions of an n-gram table for what it needs: one sorted, packed request a partition with its own distinct n-grams
and their training counts, so a frequent word or pair is one entry a chunk. A partition merges all requests, keeps
the merged counts as its part of the model, and answers each request in its order. Only packed distinct n-grams are
shuffled, never tokens or texts; chunks lie in a table bucketed by chunk, so answers come to them.

A word's level: P(w) = (c + 0.5) / (N + 0.5 (V + 1)), where every unknown word is the one further event. A bigram's
level: d(c) c / C(h) for seen ones, with Good-Turing discounts up to K, and else a(h) P(w), where a(h) spreads what h
has left over what P gives the words not seen behind h. Histories without any training count leave P(w) as it is."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, is_train, mix, partitions, text_slices, tidy, word_hashes

#: Counts above K aren't discounted.
K = 5
#: Tokens of a chunk, about; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: The end of a text as a word's hash; the history of a first token, and an unknown word, as word numbers.
END = np.uint64(0x5851F42D4C957F2D)
START, UNKNOWN = np.int64((1 << 62) + 1), np.int64((1 << 62) + 2)


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers cost what they need."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def ranges(where: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(value, from, to) for each of the ascending values below n that occurs."""
    cuts = np.searchsorted(where, np.arange(n + 1))
    return [(int(v), int(cuts[v]), int(cuts[v + 1])) for v in np.flatnonzero(np.diff(cuts))]


def owner(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash, by its highest bits."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks: documents with their tokens as numbers into the chunk's ascending distinct word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, hashes, total = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, total
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [(task << 24) + made, list(ids), list(held), list(sizes), pack(tokens.astype(np.uint32)), pack(words)]
            made, total = made + 1, 0
            for x in (ids, held, sizes, hashes):
                x.clear()
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=["chunk", "doc_ids", "held", "sizes", "tokens", "words"])

        for batch in batches:
            for part in text_slices(batch):
                found, before = word_hashes(part["text"], lower=True)
                n = np.diff(before)
                at = np.cumsum(n) + np.arange(len(n))  # an end behind each text
                whole = np.empty(len(found) + len(n), np.uint64)
                ends = np.zeros(len(whole), bool)
                ends[at] = True
                whole[ends], whole[~ends] = END, found
                ids += part["doc_id"].to_pylist()
                held += part["held"].to_pylist()
                sizes += (n + 1).tolist()
                hashes.append(whole)
                total += len(whole)
                if total >= CHUNK:
                    yield chunk()
        if total:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~is_train()).alias("held"), "text").mapInArrow(tidy(run), CHUNKS)


class Chunk:
    """A chunk's row, and its bigrams as the table of bigrams is asked for them."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["doc_ids"], np.asarray(row["sizes"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(~self.held, self.sizes)

    def words(self, answers: list[dict], parts: int) -> None:
        """Takes the answers of the word table: training count and number of each distinct word."""
        answers = sorted(answers, key=lambda a: a["part"])
        self.count = np.concatenate([unpack(a["counts"], np.int64) for a in answers])
        number = np.concatenate([np.arange(0)] + [unpack(a["numbers"], np.int64) for a in answers])
        self.number = np.where(self.count > 0, number, UNKNOWN)

    def bigrams(self, parts: int, hot: int) -> None:
        """The distinct bigrams whose history was seen, by partition, history and word.

        A history seen more than hot times is dealt out by its words, so no partition gets one whole."""
        n = len(self.count)
        history = np.append(n, self.tokens[:-1])
        history[self.first] = n
        seen = np.append(self.count > 0, True)
        h_number = np.append(np.where(self.count > 0, self.number, -1), START)
        self.usable = seen[history]
        key = history * (n + 1) + self.tokens
        key, self.entry = np.unique(key[self.usable], return_inverse=True)
        train = np.bincount(self.entry, weights=self.learnt[self.usable], minlength=len(key)).astype(np.int64)
        h_local, w_local = key // (n + 1), key % (n + 1)
        h, w = h_number[h_local], self.number[w_local]
        spread = np.append(self.count > hot, True)[h_local]
        place = mix(np.where(spread, mix(w.astype(np.uint64)), np.uint64(0)) ^ mix(h.astype(np.uint64)))
        self.part = owner(place, parts)
        self.order = np.lexsort((w, h, self.part))
        self.h, self.w, self.train, self.w_count = h, w, train, self.count[w_local]
        self.spread = spread


WORD_ASK = "part int, chunk long, keys binary, counts binary"


def ask_words(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, words = Chunk(row), unpack(row["words"], np.uint64)
                counts = np.bincount(c.tokens, weights=c.learnt, minlength=len(words)).astype(np.int64)
                for part, a, b in ranges(owner(words, parts), parts):
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([pack(words[a:b])]), pa.array([pack(counts[a:b])])], names=["part", "chunk", "keys", "counts"])

    return chunks.mapInArrow(tidy(run), WORD_ASK)


def count_words(asked: DataFrame, parts: int) -> DataFrame:
    """Answers (part, chunk, counts, numbers), and for each partition one row without chunk: its tokens and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        part = rows[0]["part"]
        keys = [unpack(r["keys"], np.uint64) for r in rows]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, back, np.concatenate([unpack(r["counts"], np.int64) for r in rows]))
        numbers = np.arange(len(every), dtype=np.int64) * parts + part
        cuts = np.cumsum([0, *map(len, keys)])
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        names = ["part", "chunk", "counts", "numbers", "tokens", "words"]
        for r, a, b in zip(rows, cuts, cuts[1:]):
            at = back[a:b]
            yield pa.record_batch([pa.array([x], k) for x, k in zip([part, r["chunk"], pack(total[at]), pack(numbers[at]), None, None], kinds)], names=names)
        yield pa.record_batch([pa.array([x], k) for x, k in zip([part, None, pack(total), pack(every), int(total.sum()), int((total > 0).sum())], kinds)], names=names)

    return asked.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), "part int, chunk long, counts binary, numbers binary, tokens long, words long")


BIGRAM_ASK = "part int, chunk long, h binary, n binary, w binary, counts binary, w_counts binary, hot binary"


def ask_bigrams(joined: DataFrame, parts: int, hot: int) -> DataFrame:
    names = [x.split()[0] for x in BIGRAM_ASK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                c.words(row["answers"], parts)
                c.bigrams(parts, hot)
                o = c.order
                for part, a, b in ranges(c.part[o], parts):
                    at = o[a:b]
                    h = c.h[at]
                    first = runs(h)
                    own = [pack(h[first]), pack(np.diff(np.append(first, len(h)))), pack(c.w[at]), pack(c.train[at]), pack(c.w_count[at]), pack(c.spread[at][first].astype(np.uint8))]
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(pa.array([x]) for x in own)], names=names)

    return joined.mapInArrow(tidy(run), BIGRAM_ASK)


#: Of a history: how many bigrams have the counts 1 to K, all counts, and what the base gives its seen words.
STATS = [*(f"n{i}" for i in range(1, K + 1)), "all", "base"]
BIGRAMS = "part int, chunk long, counts binary, " + ", ".join(f"{s} binary" for s in STATS) + ", h binary, w binary, hot boolean, " + ", ".join(f"r{i} long" for i in range(1, K + 2))


def count_bigrams(asked: DataFrame, parts: int, tokens: int, words: int) -> DataFrame:
    """Answers: counts and the statistics of each history; without chunk: a partition's part of the model with its
    numbers of bigrams by count, and (hot) its share of the statistics of histories that are dealt out."""
    names = [x.split()[0] for x in BIGRAMS.split(", ")]
    kinds = {"part": pa.int32(), "chunk": pa.int64(), "hot": pa.bool_()} | {f"r{i}": pa.int64() for i in range(1, K + 2)}

    def row(**own) -> pa.RecordBatch:
        return pa.record_batch([pa.array([own.get(n)], kinds.get(n, pa.binary())) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        part = rows[0]["part"]
        firsts = [unpack(r["h"], np.int64) for r in rows]
        h = np.concatenate([np.repeat(x, unpack(r["n"], np.int64)) for x, r in zip(firsts, rows)])
        w = np.concatenate([unpack(r["w"], np.int64) for r in rows])
        order = np.lexsort((w, h))
        fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        at = order[fresh]
        h_of, w_of = h[at], w[at]
        cut_at = np.cumsum([0, *(len(x) for x in (unpack(r["w"], np.int64) for r in rows))])
        del h, w, order, fresh
        total = np.bincount(entry, weights=np.concatenate([unpack(r["counts"], np.int64) for r in rows])).astype(np.int64)
        w_count = np.concatenate([unpack(r["w_counts"], np.int64) for r in rows])[at]
        base = (w_count + 0.5) / (tokens + 0.5 * (words + 1))
        first = runs(h_of)
        known = h_of[first]
        stats = [np.add.reduceat((total == i).astype(np.int64), first) for i in range(1, K + 1)]
        stats += [np.add.reduceat(total, first), np.add.reduceat(np.where(total > 0, base, 0.0), first)]
        for r, x, a, b in zip(rows, firsts, cut_at, cut_at[1:]):
            place = np.searchsorted(known, x)
            yield row(part=part, chunk=r["chunk"], counts=pack(total[entry[a:b]]), **{n: pack(s[place]) for n, s in zip(STATS, stats)})
        seen = total > 0
        yield row(part=part, hot=False, counts=pack(total[seen]), h=pack(h_of[seen]), w=pack(w_of[seen]), **{f"r{i}": int((total == i).sum()) for i in range(1, K + 2)})
        spread = np.unique(np.concatenate([x[unpack(r["hot"], np.uint8) > 0] for x, r in zip(firsts, rows)]))
        if len(spread):
            place = np.searchsorted(known, spread)
            yield row(part=part, hot=True, h=pack(spread), **{n: pack(s[place]) for n, s in zip(STATS, stats)})

    return asked.repartitionById(parts, F.col("part")).mapInArrow(tidy(run), BIGRAMS)


def discounts(r: list[int]) -> np.ndarray:
    """d(0) to d(K) from the numbers r of bigrams with counts 1 to K + 1, by Good-Turing as Katz has it.

    Where the numbers give no discount between 0 and 1, half a count is taken off."""
    out = np.ones(K + 1)
    share = (K + 1) * r[K] / r[0] if r[0] else 1.0
    for i in range(1, K + 1):
        d = 0.0
        if r[i - 1] and share < 1:
            d = ((i + 1) * r[i] / (i * r[i - 1]) - share) / (1 - share)
        out[i] = d if 0 < d < 1 else (i - 0.5) / i
    return out


def mass(stats: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histories: whether discounts hold, the divisor of counts, and the weight of the base for unseen words.

    A history whose counts all exceed K has one count more in its divisor instead of discounts; one behind which the
    base leaves nothing unseen keeps its plain counts. So every history's probabilities add up to 1."""
    n, total, base = stats[:K], stats[K].astype(np.float64), stats[K + 1]
    lost = sum(n[i - 1] * i * (1 - d[i]) for i in range(1, K + 1))
    left = 1 - base
    closed = left <= 1e-12
    plain = (lost <= 0) | closed
    divisor = np.where(plain & ~closed, total + 1, np.maximum(total, 1))
    rest = np.where(plain, 1.0, lost) / divisor
    weight = np.where(total > 0, np.where(closed, 0.0, rest / np.where(closed, 1.0, left)), 1.0)
    return ~plain, divisor, weight


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunks(joined: DataFrame, parts: int, hot: int, tokens: int, words: int, d: np.ndarray, spread: dict[str, np.ndarray]) -> DataFrame:
    names = [x.split()[0] for x in SCORES.split(", ")]
    sent = joined.sparkSession.sparkContext.broadcast(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_hot = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                c.words(row["answers"], parts)
                c.bigrams(parts, hot)
                answers = sorted(row["bigram_answers"] or [], key=lambda a: a["part"])
                base = (c.count[c.tokens] + 0.5) / (tokens + 0.5 * (words + 1))
                chance = base.copy()
                if len(c.order):
                    o = c.order
                    total = np.concatenate([unpack(a["counts"], np.int64) for a in answers])
                    h, part = c.h[o], c.part[o]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
                    stats = [np.concatenate([unpack(a[s], np.float64 if s == "base" else np.int64) for a in answers]) for s in STATS]
                    dealt = np.flatnonzero(c.spread[o][first])
                    if len(dealt):
                        place = np.searchsorted(known_hot["h"], h[first][dealt])
                        for s, name in zip(stats, STATS):
                            s[dealt] = known_hot[name][place]
                    holds, divisor, weight = mass(stats, d)
                    run_of = np.cumsum(np.bincount(first, minlength=len(h)))[: len(h)] - 1
                    low = (c.w_count[o] + 0.5) / (tokens + 0.5 * (words + 1))
                    cut = np.where(holds[run_of], d[np.minimum(total, K)], 1.0)
                    cut = np.where(total > K, 1.0, cut)
                    p = np.where(total > 0, cut * total / divisor[run_of], weight[run_of] * low)
                    by_entry = np.empty(len(p))
                    by_entry[o] = p
                    chance[c.usable] = by_entry[c.entry]
                sums = [np.add.reduceat(np.log10(x), c.first) for x in (base, chance)]
                n_known = np.add.reduceat((c.count[c.tokens] > 0).astype(np.int64), c.first)
                columns = [c.ids, c.held, c.sizes, n_known, np.full(len(c.sizes), tokens), *sums]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    return joined.mapInArrow(tidy(run), SCORES)


def score(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model of those whose crc32 modulo 5 isn't 1.

    docs needs doc_id and text; other columns are ignored. Words are runs of [^\\x20\\x09-\\x0D] with A-Z lowered, and
    an end follows each text. Null and empty texts are their end alone. Repeated rows count and are scored as often
    as they stand; a null id counts as the empty text for the remainder. An empty table gives no rows. Without a
    training document N and V are 0 and every token has the base's chance."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "katz")
    parts = partitions(spark)
    table = f"lodestack_chunks_{uuid.uuid4().hex}"
    chunked(docs).write.bucketBy(parts, "chunk").option("path", f"{work.path}/chunks").option("compression", "none").saveAsTable(table)
    try:
        return _scored(spark.table(table), work, parts)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        work.drop("chunks")


def _scored(chunks: DataFrame, work: Workspace, parts: int) -> DataFrame:
    """The scores of all chunks, as a table."""
    words = work.table("words", count_words(ask_words(chunks, parts), parts))
    totals = words.where("chunk IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    hot = max(1, tokens // (4 * parts))
    answers = words.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "numbers")).alias("answers"))
    bigrams = work.table("bigrams", count_bigrams(ask_bigrams(chunks.join(answers, "chunk"), parts, hot), parts, tokens, distinct))
    model = bigrams.where("chunk IS NULL")
    r = model.where("NOT hot").agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0)) for i in range(1, K + 2)]).first()
    d = discounts([int(x) for x in r])
    spread = hot_stats(model.where("hot"))
    replies = bigrams.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", *STATS)).alias("bigram_answers"))
    joined = chunks.join(answers, "chunk").join(replies, "chunk", "left")
    scores = work.table("scores", score_chunks(joined, parts, hot, tokens, distinct, d, spread))
    work.drop("words")
    return scores


def hot_stats(rows: DataFrame) -> dict[str, np.ndarray]:
    """The statistics of histories that were dealt out, summed over partitions.

    There are at most 4 * partitions such histories and START, as each has over a 4 * partitions-th of all tokens, so
    their sums may reach the driver and be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array(unpack(row["h"], np.int64)), *(pa.array(unpack(row[s], np.float64 if s == "base" else np.int64)) for s in STATS)], names=["h", *STATS])

    flat = rows.select("h", *STATS).mapInArrow(tidy(run), "h long, " + ", ".join(f"{s} {'double' if s == 'base' else 'long'}" for s in STATS))
    found = flat.groupBy("h").agg(*[F.sum(s).alias(s) for s in STATS]).orderBy("h").toArrow()
    return {name: np.array(found[name]) for name in ["h", *STATS]}
