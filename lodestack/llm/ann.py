"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

Unit vectors belong to the nearest of some centroids and are coded by the signs of their randomly rotated residual from
it. The code is a point of a hypercube; its inner product with the true direction (a stored scalar) turns the inner
product of code and query, counted on packed bits, into an unbiased estimate, whose error is bounded with a probability
that a parameter fixes. A query visits cells in the order of their centroids' distance, as many as a sample shows to
hold its neighbours; there, only vectors whose bound reaches the query's fifth best so far are compared exactly. So
the work is that of the cells visited, not of all pairs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, tidy

#: Vectors that centroids and the number of visits are fitted on, about; every vector is indexed. Most centroids.
SAMPLE, CENTROIDS = 16_384, 1024
#: Share of a sample's neighbours that the visited cells must hold, and how many of the sample ask for theirs.
COVERED, ASKING = 0.96, 512
#: Standard errors by which an estimate may be off before a neighbour can be missed.
BOUND = 3.0
#: Bits to which a query's residual is rounded for counting.
PLANES = 4
#: Vectors and queries of a cell that one task compares; larger cells are dealt out. Vectors of one step, pairs compared at once.
SHARE, BLOCK, STEP, PAIRS = 32_768, 2048, 512, 50_000


def usable(v: str = "embedding") -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = F.col(v).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.col(v).isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda e: e != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: products neither overflow nor vanish, and
    no digit changes."""
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(np.ldexp(x, -(e // 2)), -(e - e // 2))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = scaled(x)
    return x / lengths(x)[:, None]


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def gaps_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to centroids, less what is the same for a row."""
    return (c * c).sum(1) - 2 * x @ c.T


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """k-means of unit vectors; fewer centroids where there are few vectors."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x) // 8))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin(gaps_to(x, c), axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def visits(x: np.ndarray, c: np.ndarray, k: int, covered: float = COVERED) -> int:
    """How many of the nearest cells hold a share of covered of the k nearest of some of the unit vectors x among all."""
    asking = x[:: max(1, len(x) // ASKING)][:ASKING]
    own = np.argmin(gaps_to(x, c), axis=1)
    place = np.argsort(np.argsort(gaps_to(asking, c), axis=1, kind="stable"), axis=1, kind="stable")
    near = np.argsort(-(asking @ x.T), axis=1, kind="stable")[:, : k + 1]  # itself among them
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(covered * len(ranks)))]) + 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    whole = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    whole[:, : bits.shape[1]] = bits
    return np.packbits(whole, axis=1).view(np.uint64)


class Index:
    """The codes of all usable vectors in tables of the shared folder, one for each length that vectors have.

    vectors needs id_col and col; other columns are ignored. Rows with a null id, and vectors that are null, empty,
    zero or hold a null or non-finite component, take no part. Repeated rows are kept; an empty table gives an empty
    index, which finds nothing. A cosine takes two vectors of one length, so each length is searched by itself."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding"):
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))
        self.rows = rows.where(F.col("id").isNotNull() & usable("v"))
        work = Workspace(vectors.sparkSession, "ann")
        counts = self.rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
        self.parts = {r["dim"]: Part(self.rows.where(F.size("v") == r["dim"]), r["dim"], r["count"], work) for r in counts}

    def search(self, queries: DataFrame, k: int = 5, bound: float = BOUND) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest of each of queries (id, v) by cosine; ties to smaller ids.

        A row with the query's own id is no candidate. Of rows that share an id the nearest counts, and of queries
        that share one the first by vector. Only candidates for the k nearest of a task are shuffled."""
        spark = queries.sparkSession
        once = queries.groupBy("id").agg(F.min("v").alias("v"))
        found = [p.candidates(once.where(F.size("v") == dim), k, bound) for dim, p in self.parts.items()]
        if not found:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Part:
    """The index of all vectors of one length."""

    def __init__(self, rows: DataFrame, dim: int, n: int, work: Workspace):
        self.dim, self.spark = dim, rows.sparkSession
        draw = F.xxhash64(F.lit(9), "id", "v").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
        chosen = rows.where(draw < min(1.0, SAMPLE / n)).orderBy(F.xxhash64("id"), "id", "v").limit(2 * SAMPLE).select("v").toArrow()["v"].combine_chunks()
        sample = unit(matrix(chosen, dim)) if len(chosen) else np.eye(1, dim)
        c = self.centroids = centroids(sample, min(CENTROIDS, math.ceil(math.sqrt(n))))
        self.sample, self.fitted = sample, {}
        self.turn = turn = rotation(dim)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(matrix(batch["v"], dim))
                own = np.argmin(gaps_to(x, c), axis=1)
                rest = (x - c[own]) @ turn.T
                far = lengths(rest)
                fit = np.where(far > 0, np.abs(rest).sum(1) / math.sqrt(dim) / np.where(far > 0, far, 1), 1.0)
                codes = packed(rest > 0)
                yield pa.record_batch([batch["id"], batch["v"], pa.array(own, pa.int32()), pa.array([b.tobytes() for b in codes], pa.binary()), pa.array(far), pa.array(fit)], names=["id", "v", "cell", "code", "far", "fit"])

        coded = rows.mapInArrow(tidy(code), "id long, v array<double>, cell int, code binary, far double, fit double")
        self.table = work.table(f"index{dim}", coded)
        self.work = work

    def visits(self, k: int) -> int:
        """Cells that a query visits for k neighbours, fitted once a k."""
        if k not in self.fitted:
            self.fitted[k] = visits(self.sample, self.centroids, k)
        return self.fitted[k]

    def candidates(self, queries: DataFrame, k: int, bound: float) -> DataFrame:
        """(query_id, vec_id, score): what each task found to be among a query's k nearest in a visited cell.

        Cells are few, so their sizes may be broadcast. Large cells are dealt out over shares of their vectors and
        blocks of the queries that visit them, so that one that holds a third of all rows is no task of its own."""
        dim, c, n_visits, mark = self.dim, self.centroids, self.visits(k), uuid.uuid4().hex

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(gaps_to(unit(matrix(batch["v"], dim)), c), axis=1, kind="stable")[:, :n_visits]
                    yield pa.record_batch([batch["id"], batch["v"], pa.array(list(near), pa.list_(pa.int32()))], names=["id", "v", "cells"])

        asked = queries.select("id", "v").mapInArrow(tidy(route), "id long, v array<double>, cells array<int>")
        asked = self.work.table(f"asked{dim}-{mark}", asked).select("id", "v", F.explode("cells").alias("cell"))
        held = self.table.groupBy("cell").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
        sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(held, "cell")
        sizes = F.broadcast(self.work.table(f"sizes{dim}-{mark}", sizes))  # a row a centroid
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(n)).cast("int")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("far", "double"), ("fit", "double"))]
        a = asked.join(sizes, "cell").withColumns({"block": deal("blocks"), "share": upto("shares")}).select("cell", "share", "block", F.lit(False).alias("member"), "id", "v", *none)
        b = self.table.join(sizes, "cell").withColumns({"share": deal("shares"), "block": upto("blocks")}).select("cell", "share", "block", F.lit(True).alias("member"), "id", "v", "code", "far", "fit")
        both = a.unionByName(b).repartition(partitions(self.spark), "cell", "share", "block").sortWithinPartitions("cell", "share", "block", "member", "id")
        return both.mapInArrow(tidy(self._compare(k, bound)), "query_id long, vec_id long, score double")

    def _compare(self, k: int, bound: float):
        dim, c, turn = self.dim, self.centroids, self.turn

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, asking, visit = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.stack([np.asarray(batch[n]).astype(np.int64) for n in ("cell", "share", "block", "member")])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:]):
                    key, part = tuple(keys[:3, lo].tolist()), batch.slice(lo, hi - lo)
                    if key != at:
                        if visit:
                            yield from visit.batches()
                        at, asking, visit = key, [], None
                    if not keys[3, lo]:
                        asking.append((np.asarray(part["id"]), matrix(part["v"], dim)))
                    elif asking:
                        visit = visit or Visit(np.concatenate([x for x, _ in asking]), np.concatenate([x for _, x in asking]), c[key[0]], turn, k, bound)
                        for i in range(0, hi - lo, STEP):
                            visit.offer(part.slice(i, STEP))
            if visit:
                yield from visit.batches()

        return run


class Visit:
    """Queries in a cell: estimates by counting bits, exact scores of what may be near, and the k best so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, centroid: np.ndarray, turn: np.ndarray, k: int, bound: float):
        self.ids, self.k, self.bound = ids, k, bound
        self.q = scaled(q)
        self.norm = lengths(self.q)
        self.dim = q.shape[1]
        rest = (self.q / self.norm[:, None] - centroid) @ turn.T
        self.gap = (rest * rest).sum(1)
        # rest is low + step * a number of PLANES bits, but for an error that is known
        self.low = rest.min(axis=1)
        self.step = np.maximum((rest.max(axis=1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((rest - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * level
        self.rounded = ((rest - near) ** 2).sum(1)
        self.total = near.sum(1)
        self.planes = [packed((level >> b & 1).astype(bool)) for b in range(PLANES)]
        self.worst = np.full(len(ids), -np.inf)
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def estimates(self, codes: np.ndarray, far: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and vector: the estimated cosine and what it may be off."""
        hits = np.zeros((len(self.ids), len(codes)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        # a code's vector is +-1 / sqrt(dim): twice the sum over its ones less the sum over all
        inner = (2 * (self.low[:, None] * ones + self.step[:, None] * hits) - self.total[:, None]) / math.sqrt(self.dim) / fit
        guess = 1 - (far**2 + self.gap[:, None] - 2 * far * inner) / 2
        spread = np.maximum(0, 1 / fit**2 - 1) * self.gap[:, None] + self.rounded[:, None] / fit**2
        return guess, self.bound * far * np.sqrt(spread / max(1, self.dim - 1)) + 1e-9

    def offer(self, part: pa.RecordBatch) -> None:
        ids, x = np.asarray(part["id"]), scaled(matrix(part["v"], self.dim))
        codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint64).reshape(len(x), -1)
        guess, slack = self.estimates(codes, np.asarray(part["far"]), np.asarray(part["fit"]))
        norm = lengths(x)
        seed = min(2 * self.k, len(ids))
        fresh = np.flatnonzero(np.isneginf(self.worst))
        if len(fresh):  # the likeliest first, to have a bar for the others
            top = np.argpartition(-guess[fresh], seed - 1, axis=1)[:, :seed]
            self._exact(ids, x, norm, np.repeat(fresh, seed), top.ravel())
        a, b = np.nonzero(guess + slack >= self.worst[:, None])
        self._exact(ids, x, norm, a, b)

    def _exact(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            other = self.ids[i] != ids[j]
            i, j = i[other], j[other]
            score = (self.q[i] * x[j]).sum(axis=1) / (self.norm[i] * norm[j])
            good = score >= self.worst[i]
            self._keep(i[good], ids[j[good]], score[good])

    def _keep(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        i, ids, score = (np.concatenate(z) for z in zip(self.rows, (i, ids, score)))
        order = np.lexsort((-score, ids, i))  # of equal ids the nearest
        i, ids, score = i[order], ids[order], score[order]
        one = np.append(True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])) if len(i) else np.zeros(0, bool)
        i, ids, score = i[one], ids[one], score[one]
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        self.rows = i[keep], ids[keep], score[keep]
        full = place == self.k - 1
        self.worst[i[full]] = score[full]

    def batches(self) -> Iterator[pa.RecordBatch]:
        i, ids, score = self.rows
        if len(i):
            yield pa.record_batch([pa.array(self.ids[i]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])
