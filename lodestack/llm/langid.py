"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, is_train, text_slices, tidy, with_columns_by

#: Labelled documents a language that the classifier is fitted on, about; the bound of the training sample.
SAMPLE = 1000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Share of the calibration documents that rejection may cost, and the confidence that is never asked to be exceeded.
REJECTED, CEILING = 0.0002, 0.4
#: Subwords from which a text can be told from what no learned language writes, and the share of such texts to reject.
ENOUGH, STRANGE = 200, 0.9
UNKNOWN = "und"


def subwords(text: str) -> np.ndarray:
    """How often each bucket is hit by the 1- to 4-grams of a text's lower-cased letters; all else is one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    points = np.where(_letters()[points], points, 32)
    if len(points) > 1:
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    return total


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


@dataclass
class Model:
    """Languages, the product of embeddings and softmax weights, biases, temperature and least confidence; of each
    language how rare its subwords are (logarithms, by language and bucket), and what a text must be as usual as."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    usual: np.ndarray | None = None
    floor: float = -np.inf

    def logits(self, hits: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hits)
        n = hits[at].astype(np.float64)
        return n @ self.weights[at] / max(1.0, n.sum()) + self.bias

    def probabilities(self, hits: np.ndarray) -> np.ndarray:
        return softmax(self.logits(hits) / self.temperature)

    def strange(self, hits: np.ndarray, language: int) -> bool:
        """A text long enough to tell whose subwords are rarer in its language than the floor."""
        n = hits.sum()
        return bool(n >= ENOUGH and float(self.usual[language] @ hits) / n < self.floor)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 1.0, seed: int = 5) -> Model | None:
    """A model of (language, buckets, hits) rows by stochastic gradient descent; None without rows.

    A fifth of the rows, by turns, is kept for calibration: the temperature that gives their labels the highest
    likelihood, the confidence below which only a share of REJECTED of them falls, and how usual a text must be. For
    that, the same rows serve as texts of no learned language: each judged by the languages that aren't its own. The
    floor rejects a share of STRANGE of those, but never more than REJECTED of the rows judged by their own."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    index = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = rows[::5] if len(rows) >= 50 else rows
    train = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    table = rng.normal(0, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            name, at, n = train[i]
            step = rate * (1 - done / steps)
            done += 1
            share = n / max(1, n.sum())
            x = share @ table[at]
            g = softmax(x @ out + bias)
            g[index[name]] -= 1
            back = out @ g
            out -= step * np.outer(x, g)
            bias -= step * 0.1 * g
            # by the shares' own scale: hits are many and small, so their step is larger
            table[at] -= 10 * step * np.outer(share, back)
    model = Model(languages, table @ out, bias)
    z = np.array([n @ model.weights[at] / max(1, n.sum()) + bias for _, at, n in held])
    truth = np.array([index[r[0]] for r in held])
    heats = np.geomspace(0.01, 20, 60)
    losses = [-np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in heats]
    model.temperature = float(heats[int(np.argmin(losses))])
    top = softmax(z / model.temperature).max(axis=1)
    model.least = float(min(CEILING, np.quantile(top, REJECTED, method="lower")))
    seen = np.full((len(languages), BUCKETS), 0.5)
    for name, at, n in train:
        seen[index[name], at] += n
    model.usual = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
    long = [(index[name], model.usual[:, at] @ n / n.sum()) for name, at, n in held if n.sum() >= ENOUGH]
    if long and len(languages) > 1:
        own = np.quantile([u[k] for k, u in long], REJECTED, method="lower")
        other = np.quantile([np.delete(u, k).max() for k, u in long], STRANGE)
        spread = float(np.std([u[k] for k, u in long]))
        model.floor = float(min(own - 2 * spread, (own + other) / 2) if other < own else own - 2 * spread)
    return model


def training_rows(docs: DataFrame, skip: int = 0, sample: int = SAMPLE, seed: int = 11) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, hits) of about sample labelled documents a language, chosen by a hash of the id and text.

    Texts are turned into hits by the executors; what reaches the driver is bounded by sample, the number of
    languages and BUCKETS. Documents whose crc32 leaves skip, and null or letterless ones, are not learnt from."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_train(skip=skip)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in able.groupBy("lang").count().collect()}
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    draw = (F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    chosen = able.where(draw < shares[F.col("lang")]).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hits = [subwords(t) for t in part["text"].to_pylist()]
                at = [np.flatnonzero(h) for h in hits]
                yield pa.record_batch([part["lang"], part["key"], pa.array(at, pa.list_(pa.int32())), pa.array([h[a] for h, a in zip(hits, at)], pa.list_(pa.int32()))], names=["lang", "key", "at", "n"])

    found = chosen.mapInArrow(tidy(run), "lang string, key long, at array<int>, n array<int>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    rows = zip(found["lang"].to_pylist(), found["at"].to_numpy(), found["n"].to_numpy())
    return [(k, np.asarray(a), np.asarray(n)) for k, a, n in rows if len(a) > 1]


def train(docs: DataFrame, skip: int = 0, sample: int = SAMPLE) -> Model | None:
    try:
        return fit(training_rows(docs, skip, sample))
    finally:
        give_back()


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected; ones of those names are replaced.

    Only the text decides. Null texts and texts without a letter are und with score 0 and rejected. Others get the
    likeliest learned language, its calibrated probability, and rejected where that is below what calibration asks
    for or, from ENOUGH subwords on, where the subwords are rarer than any learned language has them. Ties go to the first language by code point. Whole texts are read, in slices of bounded size; an empty
    table gives none. Without any labelled document every text is und."""
    letters = None if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha = _letters()
        for batch in batches:
            for part in text_slices(batch):
                names, scores, out = [], [], []
                for t in part["text"].to_pylist():
                    if not t or letters is None or not alpha[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any():
                        names.append(UNKNOWN), scores.append(0.0), out.append(True)
                        continue
                    hits = subwords(t)
                    p = letters.probabilities(hits)
                    k = int(np.argmax(p))
                    names.append(letters.languages[k]), scores.append(float(p[k])), out.append(bool(p[k] < letters.least) or letters.strange(hits, k))
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "lang_pred", "score", "rejected"])

    return with_columns_by(docs, run, T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
