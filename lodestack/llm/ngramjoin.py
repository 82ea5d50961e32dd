"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled tokens that they share.

Each distinct set of word shingles stands for all documents that have it. Its tokens are the places and values of a
minhash signature, so that two sets share a token with the probability of their likeness. In each run a set goes down
the paths of a few sampled tokens; sets alone on a path drop out, small buckets are compared, large ones are split
further, and buckets that no path splits any more are compared in blocks. Runs repeat until a pair at the threshold
is met with the target recall. Candidates of a bucket are joined to groups by their signatures; the exact shingle sets
of a group then meet once, in blocks of bounded size, so links are counted exactly and no pair is written."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix, partitions, text_slices, tidy, word_hashes
from .components import components, spread_join

WORDS, SIMILARITY = 5, 0.8
#: Places of a signature; buckets up to SMALL sets are compared, of larger ones what LEADERS leaders of a sample of
#: SAMPLED don't explain is split, up to DEPTH times. A task takes about SHARE sets of a large bucket.
PLACES, SMALL, DEPTH = 128, 64, 3
LEADERS, SAMPLED, SHARE = 32, 256, 4096
RECALL = 0.999999
#: Of what may be missed, the share that the cut of estimates takes; the runs, which cost more, have the rest.
CUT = 0.1
#: What an estimate of likeness to a leader may be off.
SLACK = 0.13
#: Sets of one block of a group, and shingles of it, at most (a single larger set is a block).
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20


def shingles(words: np.ndarray, before: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """The ascending distinct hashes of runs of size words of each text; of a shorter text the run of all of them."""
    rolled = np.zeros(len(words), np.uint64)
    n = len(words)
    if n >= size:
        for i in range(size):
            rolled[: n - size + 1] = rolled[: n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i]
        rolled = mix(rolled)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


_rng = np.random.default_rng(17)
_MULTIPLY = (_rng.integers(1, 2**32, PLACES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, PLACES, dtype=np.uint32)[:, None]


def minhash(s: np.ndarray) -> np.ndarray:
    """The least value of each of PLACES hash functions over a set."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        part = low[None, at : at + 2048] * _MULTIPLY
        part += _ADD
        np.minimum(out, part.min(axis=1), out=out)
    return out


def runs_for(similarity: float, recall: float, places: int, branches: int, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a last bucket with the wanted probability.

    A pair survives a level if it shares one of the branches sampled there; the worst case is the full depth. The
    cut of estimates, which is the same in all runs, takes its share of what may be missed."""
    level = 1 - (1 - similarity) ** branches
    one = similarity * level ** (depth - 1)
    return math.ceil(math.log((1 - recall) * (1 - CUT)) / math.log(1 - one))


def cut_for(similarity: float, recall: float, places: int) -> float:
    """The largest estimate below which a pair at the threshold falls with the share CUT of what may be missed at most.

    Places agree independently with the probability of the likeness, so their number is binomial."""
    below = 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * similarity**k * (1 - similarity) ** (places - k)
        if below > (1 - recall) * CUT:
            return k / places
    return 1.0


RUNS = runs_for(SIMILARITY, RECALL, PLACES, 2, DEPTH)


def sets_of(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, key (of the shingle set), n, the low bytes of the signature and the first path of each run."""
    places = mix(np.arange(1, runs + 1, dtype=np.uint64)) % np.uint64(PLACES)
    salts = mix(np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, before = word_hashes(part["text"])
                keys, sizes, signed, paths = [], [], [], []
                for s in shingles(words, before):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None), signed.append(None), paths.append(None)
                        continue
                    keys.append(key_of(s))
                    sig = minhash(s)
                    signed.append(sig.astype(np.uint8).tobytes())
                    paths.append(mix(sig[places.astype(np.int64)].astype(np.uint64) ^ salts).view(np.int64))
                yield pa.record_batch([part["doc_id"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signed, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sig", "paths"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), "doc_id long, key long, n int, sig binary, paths array<long>")


def key_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES)


def _split(rows: DataFrame, depth: int, branches: int = 2) -> DataFrame:
    """(path, key) one level further down: each set goes to the tokens that its path samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, sig = np.asarray(batch["path"]).view(np.uint64), signatures(batch["sig"])
            for b in range(branches):
                place = mix(path + np.uint64(depth * 64 + b)) % np.uint64(PLACES)
                token = sig[np.arange(len(sig)), place.astype(np.int64)].astype(np.uint64)
                to = mix(mix(path ^ (place << np.uint64(32))) + token + np.uint64(depth))
                yield pa.record_batch([pa.array(to.view(np.int64)), batch["key"]], names=["path", "key"])

    return rows.mapInArrow(tidy(run), "path long, key long")


def candidates(sets: DataFrame, work: Workspace, similarity: float) -> DataFrame:
    """Edges (a, b) that connect, for every bucket, the sets whose signatures are near the threshold.

    Only keys and paths are shuffled at first; signatures are fetched for buckets of two or more sets alone. Of large
    buckets, also on the last level, what follows a leader is settled over as many tasks as the bucket needs."""
    level, edges = sets.select(F.explode("paths").alias("path"), "key"), []
    for depth in range(1, DEPTH + 1):
        sizes = work.table(f"sizes{depth}", level.groupBy("path").count().where("count > 1"))
        rows = work.table(f"level{depth}", level.join(sizes, "path").join(sets.select("key", "sig"), "key"))
        edges.append(_bucket_edges(rows.where(F.col("count") <= SMALL), similarity))
        large = rows.where(F.col("count") > SMALL)
        if large.isEmpty():
            break
        led = work.table(f"led{depth}", _led(large, similarity))
        edges.append(led.where("NOT rest").select("a", "b"))
        rest = led.where("rest").select(F.col("a").alias("path"), F.col("b").alias("key"))
        if rest.isEmpty():
            break
        signed = rest.join(sets.select("key", "sig"), "key")
        if depth == DEPTH:
            edges.append(_bucket_edges(signed, similarity))
            break
        level = _split(signed, depth)
    return reduce(DataFrame.unionByName, edges).distinct()


def bounds(similarity: float) -> tuple[float, float, float]:
    """Of estimates: near enough for a candidate; near enough to follow a leader; and, by the triangle inequality of
    Jaccard distances, near enough to a leader that one of its followers could be a partner."""
    leads = similarity - 0.2
    return cut_for(similarity, RECALL, PLACES), leads, 1 - (1 - similarity) - (1 - (leads - SLACK)) - SLACK


def _led(rows: DataFrame, similarity: float) -> DataFrame:
    """(rest, a, b) of large buckets: edges to leaders, and with rest the (path, key) of sets that follow none.

    Leaders are drawn from a bounded sample of each bucket; every set of the bucket is compared with them, over as many
    tasks as the bucket needs. A set is joined to all leaders whose followers could be its partners, so a pair of which
    one follows a leader is never apart; pairs of which both follow none meet again when the rest is split."""
    _, leads, related = bounds(similarity)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, own = None, []
        for batch in batches:
            out: list[tuple] = []
            for p, k, s in zip(batch["path"].to_pylist(), batch["key"].to_pylist(), signatures(batch["sig"]) if batch.num_rows else ()):
                if p != path:
                    path, own = p, []
                if len(own) < LEADERS and not (own and ((np.array(own) == s).mean(axis=1) >= leads).any()):
                    own.append(s)
                    out.append((p, k, s.tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["path", "key", "sig"])

    sample = rows.where(F.pmod(F.xxhash64("key", "path"), F.col("count")) < SAMPLED)
    leaders = sample.repartition("path").sortWithinPartitions("path", "key").select("path", "key", "sig").mapInArrow(tidy(lead), "path long, key long, sig binary")
    shares = F.ceil(F.col("count") / SHARE)
    paths = rows.groupBy("path").agg(F.first("count").alias("count"))
    first = leaders.join(paths, "path").select("path", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.lit(False).alias("member"), "key", "sig")
    members = rows.select("path", F.pmod(F.xxhash64(F.lit(5), "key"), shares).alias("share"), F.lit(True).alias("member"), "key", "sig")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, names, over = None, [], [], []
        for batch in batches:
            out: list[tuple] = []
            for p, share, member, k, s in zip(*(batch[c].to_pylist() for c in ("path", "share", "member", "key")), signatures(batch["sig"]) if batch.num_rows else ()):
                if (p, share) != at:
                    at, own, names, over = (p, share), [], [], []
                if not member:
                    own.append(s), names.append(k), over.append(len(over))
                    continue
                same = (np.array(own) == s).mean(axis=1) if own else np.zeros(0)
                roots = list(dict.fromkeys(root(over, int(j)) for j in np.flatnonzero(same >= related)))
                for r in roots[1:]:
                    out.append((False, names[r], names[roots[0]]))
                    over[r] = roots[0]
                if roots and names[roots[0]] != k:
                    out.append((False, k, names[roots[0]]))
                if not (same >= leads).any():
                    out.append((True, p, k))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.int64(), pa.int64()))], names=["rest", "a", "b"])

    dealt = first.unionByName(members).repartition("path", "share").sortWithinPartitions("path", "share", "member", "key")
    return dealt.mapInArrow(tidy(follow), "rest boolean, a long, b long")


def root(over: list[int], i: int) -> int:
    """The root of i in a list of parents, halving the way."""
    while over[i] != i:
        over[i] = over[over[i]]
        i = over[i]
    return i


class Rows:
    """Signatures that grow in number; each is copied a bounded number of times."""

    def __init__(self) -> None:
        self.n, self.room = 0, np.zeros((16, PLACES), np.uint8)

    def append(self, row: np.ndarray) -> None:
        if self.n == len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n] = row
        self.n += 1

    def filled(self) -> np.ndarray:
        return self.room[: self.n]

    def clear(self) -> None:
        self.__init__()


def _bucket_edges(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges between near sets of each bucket, read in blocks of SMALL.

    A bucket of one block is compared in full. Of a larger one, which DEPTH splits have left, each set is joined to
    all leaders whose followers could be its partners, and leads itself if it follows none: no two sets above the
    threshold end up apart. Only edges that join what was apart are written, so a bucket gives fewer edges than twice
    its sets. Memory holds a block and the leaders of one bucket."""
    near_enough, leads, related = bounds(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_k: list[int] = []
        block_s: list[np.ndarray] = []
        leaders: tuple[list[int], Rows] = ([], Rows())
        over: list[int] = []  # of each leader, one that it is joined to, itself at the root
        path, blocks = None, 0
        out: tuple[list[int], list[int]] = ([], [])

        def link(a: int, b: int) -> None:
            out[0].append(int(a)), out[1].append(int(b))

        def flush(end: bool) -> None:
            nonlocal blocks
            k, s = np.array(block_k, np.int64), np.array(block_s)
            block_k.clear(), block_s.clear()
            if end and not blocks:
                if len(k) > 1:
                    label = labels(np.array([(s == x).mean(axis=1) >= near_enough for x in s]))
                    for i in np.flatnonzero(label != np.arange(len(k))):
                        link(k[i], k[label[i]])
            else:
                for i in range(len(k)):
                    same = (leaders[1].filled() == s[i]).mean(axis=1)
                    roots = list(dict.fromkeys(root(over, int(j)) for j in np.flatnonzero(same >= related)))
                    for r in roots[1:]:
                        link(leaders[0][r], leaders[0][roots[0]])
                        over[r] = roots[0]
                    if roots:
                        link(k[i], leaders[0][roots[0]])
                    if not (same >= leads).any():
                        over.append(roots[0] if roots else len(over))
                        leaders[0].append(int(k[i])), leaders[1].append(s[i])
            blocks += 1
            if end:
                blocks = 0
                leaders[0].clear(), leaders[1].clear(), over.clear()

        for batch in batches:
            for p, k, s in zip(batch["path"].to_pylist(), batch["key"].to_pylist(), signatures(batch["sig"]) if batch.num_rows else ()):
                if p != path:
                    flush(True)
                    path = p
                elif len(block_k) >= SMALL:
                    flush(False)
                block_k.append(k), block_s.append(s)
            if out[0]:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
                out[0].clear(), out[1].clear()
        flush(True)
        if out[0]:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.repartition("path").sortWithinPartitions("path", "key").select("path", "key", "sig").mapInArrow(tidy(run), "a long, b long")


def _wanted(keys: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the documents (doc_id, key) whose sets are needed, of 2**16 to 2**28 bits; false hits only cost."""
    bits = min(1 << 28, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    at = F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("key")).bitwiseAND(F.lit(bits - 1))
    pieces = keys.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    found = bytearray(bits // 8)
    for r in pieces:  # pieces and places count from 1
        at = (r["piece"] - 1) * 4096
        for i, byte in enumerate(r["bits"]):
            if byte and at + i < len(found):
                found[at + i] |= byte
    return bytes(found), bits


def _packed(docs: DataFrame, bitmap: bytes, bits: int) -> DataFrame:
    """doc_id, key and 48-bit shingles of the documents that the bitmap may want."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            for part in text_slices(batch):
                words, before = word_hashes(part["text"])
                rows = []
                for doc_id, s in zip(part["doc_id"].to_pylist(), shingles(words, before)):
                    if len(s):
                        key = key_of(s)
                        at = ((doc_id or 0) ^ key) & (bits - 1)
                        if wanted[at >> 3] >> (at & 7) & 1:
                            rows.append((doc_id, key, s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "key", "body"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), "doc_id long, key long, body binary")


def unpack(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b, by products of incidence matrices in slices."""
    sizes = np.array([len(x) for x in [*a, *b]])
    _, name, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    often = times[name] > 1
    name, owner = name[often], owner[often]
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(name):
        return out
    column = np.cumsum(np.append(0, name[1:] != name[:-1]))
    width = max(64, (1 << 22) // len(sizes))
    for at in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sizes), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(m[: len(a)] @ m[len(a) :].T).astype(np.int64)
    return out


def labels(near: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by a symmetric matrix of neighbours."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def linked(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    inner = shared(a, b)
    total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - inner
    return inner >= similarity * total - 1e-9


def _exact(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, partner, links): documents linked to a set through one pair of blocks, and an edge of its component.

    rows: pair of blocks (task), side, key, copies, body. A pair of blocks is bounded; sides 0 and 1 stand for the
    two blocks, and side 2 for a block with itself."""

    def solve(group: list[tuple]) -> list[tuple[int, int, int]]:
        sides: list[list] = [[], [], []]
        for side, key, copies, body in group:
            sides[side].append((key, copies, unpack(body)))
        left, right = (sides[2], sides[2]) if sides[2] else sides[:2]
        if not left or not right or len(left) == 1 and right is left:
            return []
        near = linked([x[2] for x in left], [x[2] for x in right], similarity)
        if right is left:
            np.fill_diagonal(near, False)
        every = left if right is left else left + right
        keys, copies = [x[0] for x in every], np.array([x[1] for x in every])
        if right is left:
            whole = near
        else:
            whole = np.zeros((len(every), len(every)), bool)
            whole[: len(left), len(left) :] = near
            whole[len(left) :, : len(left)] = near.T
        links = whole @ copies
        label = labels(whole)
        return [(keys[i], keys[label[i]], int(links[i])) for i in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group, out = None, [], []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("task", "side", "key", "copies", "body")]
            for t, *row in zip(*columns):
                if t != task:
                    out += solve(group)
                    task, group = t, []
                group.append(row)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "partner", "links"])
                out = []
        out = solve(group)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "partner", "links"])

    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task").select("task", "side", "key", "copies", "body").mapInArrow(tidy(run), "key long, partner long, links long")


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Documents are linked if the Jaccard likeness of their sets of five-word shingles reaches similarity; a text of
    fewer words has one shingle, all of them. class_id is the least doc_id that links lead to, n_links how many other
    documents are linked directly. Words are runs of [^\x20\x09-\x0D], in their case. docs needs doc_id and text;
    other columns are ignored. Null, empty and wordless texts have no links and are their own class. Repeated rows
    are linked to each other; a null doc_id is the class only of documents without another. An empty table gives no
    rows."""
    work = Workspace(docs.sparkSession, "join")
    sets = work.table("sets", sets_of(docs))
    full = sets.where("key IS NOT NULL")
    uniq = work.table("uniq", full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.max("sig").alias("sig"), F.first("paths").alias("paths")))
    edges = candidates(uniq, work, similarity)
    groups = components(edges, work, "near").withColumnsRenamed({"node": "key", "label": "group"})
    members = work.table("grouped", groups.join(uniq.select("key", "doc_id", "copies", "n"), "key"))
    stats = members.groupBy(F.col("group").alias("_group")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = work.table("members", spread_join(members, stats, "group", "_group", members.count()).drop("_group").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))))
    bodies = _packed(docs, *_wanted(members.select("doc_id", "key")))
    placed = bodies.join(members.withColumnRenamed("doc_id", "_own"), "key").where(F.col("doc_id").eqNullSafe(F.col("_own")))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    copies = copies.withColumn("side", F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))).withColumn("task", F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")))
    once = copies.dropDuplicates(["task", "key"])  # rows repeated with one id and text
    exact = work.table("exact", _exact(once, similarity))
    classes = components(exact.select(F.col("key").alias("a"), F.col("partner").alias("b")), work, "class").withColumnsRenamed({"node": "key", "label": "root"})
    links = exact.groupBy("key").agg(F.sum("links").alias("links"))
    known = uniq.select("key", "doc_id", "copies").join(classes, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = work.table("known", known)
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_key = spread_join(known, least.withColumnRenamed("root", "_root"), "root", "_root", known.count()).select("key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = full.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id", "n_links")
    alone = sets.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone)
