"""Periodic runs of words: matches are counted by lag, and only lags with enough of them are searched for islands.

A run of period p is a stretch whose words p apart are identical; 4 p words of it are at least 3 p matches in a row at
lag p. How many matches a text has at a lag is counted exactly: words that occur often add the autocorrelation of where
they stand (by FFT), rare ones the differences of their places. Of a lag with enough matches, islands are sought from
anchors p apart, as three of them lie inside every island that is long enough."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices, with_columns_by

#: Words that a run must have, and how often its period must fit into it.
LEAST, TIMES = 6, 4
#: Differences of places that are counted at once.
STEP = 1 << 20
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts in order, and how many stand before each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(pc.binary_length(flat), 0)
    flat, parents = flat.filter(solid), parents.filter(solid).to_numpy(zero_copy_only=False)
    return flat, np.searchsorted(parents, np.arange(len(column) + 1))


def often(n: np.ndarray) -> np.ndarray:
    """Occurrences from which a word of a text of n words is counted by FFT: there the pairs cost as much."""
    return np.maximum(48, np.sqrt(n * np.log2(np.maximum(2, n)) / 4)).astype(np.int64)


def lag_counts(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of every text at the lags 1 to n // TIMES, end to end, and where the counts of each text begin.

    ids are the words of all texts, before how many stand before each text."""
    n = np.diff(before)
    reach = n // TIMES
    offsets = np.append(0, np.cumsum(reach))
    counts = np.zeros(offsets[-1], np.int64)
    if not len(counts):
        return counts, offsets
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    heavy = size >= often(n)[text[order[first]]]
    # rare words: the k-th next place of the same word, for all words and texts at once
    left = np.repeat(np.where(heavy, 0, first + size - 1), size) - np.arange(len(key))
    at = np.flatnonzero(left > 0)
    at = at[np.argsort(-left[at], kind="stable")]
    left = left[at]
    gathered, held, k = [], 0, 1
    while len(at):
        lag = order[at + k] - order[at]
        own = text[order[at]]
        near = lag <= reach[own]
        gathered.append((offsets[own] + lag - 1)[near])
        held += len(gathered[-1])
        if not near.all():  # later places are farther still
            at, left = at[near], left[near]
        k += 1
        at = at[: int(np.searchsorted(-left, -k, side="right"))]
        left = left[: len(at)]
        if held >= STEP:
            counts += np.bincount(np.concatenate(gathered), minlength=len(counts))
            gathered, held = [], 0
    if gathered:
        counts += np.bincount(np.concatenate(gathered), minlength=len(counts))
    # frequent words: the power spectra of where they stand are added up, and turned back once a text
    owner = text[order[first]]
    for t in np.unique(owner[heavy]):
        if not reach[t]:
            continue
        wide = smooth(int(n[t] + reach[t]))
        power = np.zeros(wide // 2 + 1)
        for g in np.flatnonzero(heavy & (owner == t)):
            here = np.zeros(wide)
            here[order[first[g] : first[g] + size[g]] - before[t]] = 1
            z = np.fft.rfft(here)
            power += z.real**2 + z.imag**2
        counts[offsets[t] : offsets[t + 1]] += np.rint(np.fft.irfft(power, wide)[1 : reach[t] + 1]).astype(np.int64)
    return counts, offsets


def smooth(n: int) -> int:
    """The least number of the form 2^a, 3 * 2^a or 5 * 2^a from n on."""
    return min(m << max(0, math.ceil(math.log2(n / m))) for m in (1, 3, 5))


def islands(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, length) of a text with words p apart identical, of enough words for period p."""
    n, need = len(ids), max(LEAST, TIMES * p) - p
    last = n - p  # places that have a word p on
    if need < 3 * p or p < 4:
        parts = [(0, last)]
    else:
        anchors = np.arange(0, last, p)
        same = ids[anchors] == ids[anchors + p]
        hit = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        for step in (p // 2, p // 3, p // 5, p - 1):  # most chance hits go here
            a = anchors[hit]
            hit = hit[(ids[a + step] == ids[a + step + p]) & (ids[a + p + step] == ids[a + p + step + p])]
        if not len(hit):
            return []
        low, high = np.maximum(0, anchors[hit] - p + 1), np.minimum(last, anchors[hit] + 3 * p)
        new = np.append(True, low[1:] > np.maximum.accumulate(high)[:-1])
        begins = np.flatnonzero(new)
        parts = list(zip(low[begins].tolist(), np.maximum.reduceat(high, begins).tolist()))
    found = []
    for a, b in parts:
        same = np.zeros(b - a + 2, bool)
        same[1:-1] = ids[a:b] == ids[a + p : b + p]
        flips = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(flips[::2].tolist(), flips[1::2].tolist()):
            if e - s >= need:
                found.append((a + s, e - s + p))
    return found


def runs_of(ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text, by start and period; counts are its matches by lag.

    Lags are tried in ascending order. A run of period q also matches at the multiples of q, and no run of such a period
    shares a match with it: its matches are taken off there, so that one long run doesn't open all multiples."""
    lags = np.arange(1, len(counts) + 1)
    need = np.maximum(LEAST, TIMES * lags) - lags
    counts, found = counts.copy(), {}
    for p in np.flatnonzero(counts >= need) + 1:
        if counts[p - 1] < need[p - 1]:
            continue
        for start, length in islands(ids, int(p)):
            if (start, length) not in found:
                found[start, length] = int(p)
                multiples = np.arange(2 * p, min(len(counts) + 1, length), p)
                counts[multiples - 1] -= length - multiples
    return sorted((s, n, p) for (s, n), p in found.items())


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges[:n]) == 0)


def find(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed: the words that no run
    repeats, joined by one blank. Columns of those names are replaced.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a maximal stretch whose smallest period p fits TIMES times
    into it, of LEAST words at least; of it, what follows the first p words goes. Null and empty texts have no words, no
    runs and an empty collapsed text; repeated rows are treated alike; all other columns stay. Whole texts are read, in
    slices of bounded size, and one longer text by itself. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words, before = words_of(part["text"])
                ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                counts, offsets = lag_counts(ids, before)
                every, stay, lengths = [], [], np.diff(before)
                for t in candidates(counts, offsets):
                    a, b = int(before[t]), int(before[t + 1])
                    if runs := runs_of(ids[a:b], counts[offsets[t] : offsets[t + 1]]):
                        every.append((t, runs))
                        stay.append((a, b, a + kept(b - a, runs)))
                        lengths[t] = len(stay[-1][2])
                if stay:
                    gone = np.zeros(len(words) + 1, bool)
                    for a, b, k in stay:
                        gone[a:b] = True
                        gone[k] = False
                    words = words.filter(pa.array(~gone[:-1]))
                left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), words)
                joined = pc.binary_join(left, pa.scalar(" ", words.type)).cast(pa.string())
                runs = [[]] * part.num_rows
                for t, r in every:
                    runs[t] = [dict(zip(("start", "length", "period"), x)) for x in r]
                kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(before), pa.int64()), pa.array(runs, kind), joined], names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return with_columns_by(docs, run, T.StructType().add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string"))


def candidates(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with enough matches at some lag."""
    reach = np.diff(offsets)
    lags = np.arange(1, len(counts) + 1) - np.repeat(offsets[:-1], reach)
    enough = np.flatnonzero(counts >= np.maximum(LEAST, TIMES * lags) - lags)
    return np.unique(np.searchsorted(offsets, enough, side="right") - 1)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length by period, and digests of all runs and of what is left."""
    # kept as integers: a run beats the best so far if length * its period is greater
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
