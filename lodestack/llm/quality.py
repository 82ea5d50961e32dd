"""A quality classifier by attention-based multiple-instance learning, trained in numpy.

A text is a bag of passages. Each is encoded as the averaged embeddings of its hashed byte and shape n-grams and of
marks of repeated words; a gated attention, learnt from labels of whole documents alone, weighs passages, and the
weighted mean is scored. So a text is
judged by the passages that decide, however long the rest is."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, give_back, span_hashes, text_buffers, text_slices, tidy, with_columns_by, word_spans

#: Words of a passage.
PASSAGE = 64
#: Labelled documents a class that the classifier is fitted on, about, and passages of such a document, evenly spread:
#: the bounds of the training sample. Scoring reads every passage of every document.
SAMPLE, SAMPLE_PASSAGES = 1500, 32
BUCKETS, WIDTH, GATE = 1 << 13, 16, 8
#: Lengths of n-grams of bytes, and of shapes (letters, capitals, digits and marks look alike in all languages).
BYTES, SHAPES = (1, 2), (1, 2, 3, 4)
#: Blanks behind every text, so that no n-gram reaches into the next one.
PAD = max(*BYTES, *SHAPES)
#: Bytes whose n-grams are embedded at once.
STEP = 1 << 17

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[0x80:] = ord("a")  # letters beyond ASCII are seldom capitals
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")


def marks(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every byte whether its word is new in its passage (0), stood before in it (1) or just before (2); 3 if none."""
    starts, ends, before = word_spans(np.append(at, len(body)), body)
    h, own = span_hashes(body, starts, ends), np.repeat(np.arange(len(at)), np.diff(before))
    order = np.lexsort((h, own))
    kind = np.zeros(len(h), np.uint8)
    kind[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    kind[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])] = 2
    found = np.full(len(body), 3, np.uint8)
    found[~SPACE[body]] = np.repeat(kind, ends - starts)
    return found


def grams(body: np.ndarray, marked: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of every byte, one array a kind: the n-grams that begin there, and the mark of its word."""
    yield BUCKETS + marked.astype(np.int64)
    for k, (base, sizes) in enumerate(((body, BYTES), (_SHAPE[body], SHAPES))):
        wide = np.append(base, np.full(max(sizes), 32, np.uint8)).astype(np.uint32)
        h = np.full(len(base), 7 + k, np.uint32)
        for n in sizes:
            h = h * np.uint32(0x01000193) + wide[n - 1 : n - 1 + len(base)] + np.uint32(n)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield ((mixed >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int64)


KINDS = 1 + len(BYTES) + len(SHAPES)


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, PAD blanks after each; where their passages of PASSAGE words begin and end; and how many
    passages stand before each text. A text without words is one passage, an empty one of no bytes."""
    offsets, solid = text_buffers(column)
    body = np.full(len(solid) + PAD * len(column), 32, np.uint8)
    body[np.arange(len(solid)) + PAD * np.repeat(np.arange(len(column)), np.diff(offsets))] = solid
    close = offsets[1:] + PAD * np.arange(len(column))
    offsets = offsets + PAD * np.arange(len(offsets))
    starts, _, before = word_spans(offsets, body)
    words = np.diff(before)
    n = np.maximum(1, -(-words // PASSAGE))
    first = np.append(0, np.cumsum(n))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], n)
    at = np.repeat(offsets[:-1], n)  # the first passage has what stands before its first word
    later = nth > 0
    at[later] = starts[(np.repeat(before[:-1], n) + nth * PASSAGE)[later]]
    ends = np.append(at[1:], 0)
    ends[first[1:] - 1] = close
    return body, at, ends, first


@dataclass
class Model:
    """Embeddings, the gate's and the attention's weights, and the classifier's, with its temperature."""

    table: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    bias: float
    temperature: float = 1.0
    #: Logarithm of how much likelier label 1 is among all labels than in the sample.
    prior: float = 0.0

    def encode(self, body: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each passage, which begin at at: tanh of the mean embedding of its n-grams."""
        total, marked, sums = np.zeros((len(at), WIDTH), np.float32), marks(body, at), np.zeros(len(body) + 1, np.int8)
        sums[at] += 1  # bytes of passages are 1, blanks behind texts 0
        np.subtract.at(sums, ends, 1)
        real = np.cumsum(sums)[:-1] > 0
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, at[low] + STEP, side="right")))
            a, b = int(at[low]), int(ends[low:high].max())
            if b > a:
                for cut in range(a, b, STEP):  # a passage may be longer than a step
                    to = min(b, cut + STEP)
                    more = min(len(body), to + PAD)
                    summed = sum(self.table[g[: to - cut]] for g in grams(body[cut:more], marked[cut:more]))
                    summed[~real[cut:to]] = 0
                    own = np.clip(at[low:high], cut, to) - cut
                    filled = np.flatnonzero(np.append(own[1:], to - cut) > own)
                    if len(filled):
                        total[low + filled] += np.add.reduceat(summed, own[filled], axis=0)
            low = high
        return np.tanh(total / (KINDS * np.maximum(1, ends - at))[:, None])

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each bag; first says where its passages begin. Every bag has one at least."""
        a = (np.tanh(h @ self.tanh) / (1 + np.exp(-(h @ self.gate)))) @ self.attend
        top = np.maximum.reduceat(a, first[:-1])
        w = np.exp(a - np.repeat(top, np.diff(first)))
        z = (np.add.reduceat(w[:, None] * h, first[:-1], axis=0) / np.add.reduceat(w, first[:-1])[:, None]) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z / self.temperature + self.prior, -500, 500)))


def fit(bags: list[tuple[int, list[np.ndarray]]], epochs: int = 8, rate: float = 0.05, seed: int = 3) -> Model | None:
    """A model of (label, passages as bytes) bags by Adagrad, a bag a step; None without bags.

    A fifth of the bags, by turns, is kept for calibration: the temperature that gives their labels the highest
    likelihood. With one class alone, every score is near that label."""
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    bags = [bags[i] for i in rng.permutation(len(bags))]
    encoded = []
    for label, parts in bags:
        rows = []
        for body in parts:
            at, n = np.unique(np.concatenate(list(grams(body, marks(body, np.zeros(1, np.int64))))), return_counts=True) if len(body) else (np.zeros(0, np.int64), np.zeros(0))
            rows.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        first = np.append(0, np.cumsum([len(r[0]) for r in rows]))
        encoded.append((label, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), first))
    held = encoded[::5] if len(encoded) >= 50 else encoded
    train = [e for i, e in enumerate(encoded) if i % 5] if len(encoded) >= 50 else encoded
    w = [rng.normal(0, 1, (BUCKETS + 4, WIDTH)), rng.normal(0, 0.3, (WIDTH, GATE)), rng.normal(0, 0.3, (WIDTH, GATE)), rng.normal(0, 0.3, GATE), np.zeros(WIDTH), np.zeros(1)]
    past = [np.full_like(x, 1e-6) for x in w]

    def step(k: int, g: np.ndarray, at=slice(None)) -> None:
        past[k][at] += g * g
        w[k][at] -= rate * g / np.sqrt(past[k][at])

    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            label, at, n, first = train[i]
            h = np.tanh(np.array([n[a:b] @ w[0][at[a:b]] for a, b in zip(first, first[1:])]))
            t, s = np.tanh(h @ w[1]), 1 / (1 + np.exp(-(h @ w[2])))
            a = (t * s) @ w[3]
            a = np.exp(a - a.max())
            a /= a.sum()
            m = a @ h
            err = 1 / (1 + np.exp(-np.clip(m @ w[4] + w[5][0], -500, 500))) - label
            back = err * w[4]
            da = a * (h @ back - m @ back)  # through the softmax
            ds, dt = da[:, None] * t * w[3] * s * (1 - s), da[:, None] * s * w[3] * (1 - t * t)
            dh = a[:, None] * back + ds @ w[2].T + dt @ w[1].T
            dx = dh * (1 - h * h)
            g = np.repeat(dx, np.diff(first), axis=0) * n[:, None]
            each, where = np.unique(at, return_inverse=True)
            if len(first) > 2:
                g = np.stack([np.bincount(where, g[:, c], len(each)) for c in range(WIDTH)], axis=1)
                step(0, g, each)
            else:
                step(0, g, at)
            step(1, h.T @ dt), step(2, h.T @ ds), step(3, (t * s).T @ da), step(4, err * m), step(5, np.array([err]))
    model = Model(w[0].astype(np.float32), w[1], w[2], w[3], w[4], float(w[5][0]))
    hidden = [np.tanh(np.array([n[a:b] @ model.table[at[a:b]] for a, b in zip(first, first[1:])])) for _, at, n, first in held]
    p = model.scores(np.concatenate(hidden), np.append(0, np.cumsum([len(h) for h in hidden])))
    z, truth = np.log(np.clip(p, 1e-12, 1) / np.clip(1 - p, 1e-12, 1)), np.array([e[0] for e in held])
    heats = np.geomspace(0.3, 10, 40)
    losses = [np.mean(np.logaddexp(0, np.where(truth == 1, -z, z) / t)) for t in heats]
    model.temperature = float(heats[int(np.argmin(losses))])
    return model


def is_held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, spread: int = SAMPLE_PASSAGES, seed: int = 17) -> tuple[list[tuple[int, list[np.ndarray]]], float]:
    """(label, passages) of about sample labelled documents a class, chosen by a hash of id and label.

    Documents that are held out, ids without a text and labels other than 0 and 1 are not learnt from; a document with
    both labels counts once for each. Labels are drawn before they meet texts, so what is broadcast and what reaches
    the driver is bounded by sample; of a document, spread passages at most come, evenly spread over all of it. Second,
    the logarithm of how much likelier label 1 is among all labels than in the sample."""
    able = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in able.groupBy("quality").count().collect()}
    if not counts:
        return [], 0.0
    shares = [min(1.0, sample / counts.get(k, 1)) for k in (0, 1)]
    share = F.when(F.col("quality") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("quality")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    chosen = able.where(draw < share).withColumnRenamed("doc_id", "_id")
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("quality", F.xxhash64("doc_id", "text").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                body, at, ends, first = passages(part["text"])
                bags = []
                for a, b in zip(first, first[1:]):
                    picked = np.unique(np.linspace(a, b - 1, min(spread, b - a)).astype(np.int64))
                    bags.append([body[at[i] : ends[i]].tobytes() for i in picked])
                yield pa.record_batch([part["quality"], part["key"], pa.array(bags, pa.list_(pa.binary()))], names=["quality", "key", "bag"])

    found = texts.mapInArrow(tidy(run), "quality int, key long, bag array<binary>").toArrow().sort_by([("key", "ascending"), ("quality", "ascending")])
    bags = [(q, [np.frombuffer(x, np.uint8) for x in bag]) for q, bag in zip(found["quality"].to_pylist(), found["bag"].to_pylist())]
    return bags, math.log(shares[0] / shares[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    try:
        bags, prior = training_bags(docs, labels, sample)
        model = fit(bags)
        del bags
    finally:
        give_back()
    if model is not None:
        model.prior = prior
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with score (the probability of label 1) and predicted; ones of those names are replaced.

    Only the text decides. Null and empty texts are one passage without n-grams; every passage of other texts is read,
    in slices of bounded size. Equal texts score alike to rounding. Without any label every score is 0.5. An empty
    table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                if model is None:
                    p = np.full(part.num_rows, 0.5)
                else:
                    body, at, ends, first = passages(part["text"])
                    p = model.scores(model.encode(body, at, ends), first)
                columns = [*part.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "score", "predicted"])

    return with_columns_by(docs, run, T.StructType().add("score", "double").add("predicted", "integer"))
