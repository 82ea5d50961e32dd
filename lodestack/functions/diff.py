"""Differences of two lists of lines: a shortest edit script, and what it makes of the older list."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

#: Cells of a table of common lengths that is filled at once (32 bits each); larger blocks are parted first.
CELLS = 1 << 22
SCRIPT = "array<struct<start:int,kept:int,dropped:int,added:array<string>>>"


def common_lengths(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Lengths of the longest common subsequences of a's prefixes (whole: all of them, else a itself) and b's."""
    row = np.zeros(len(b) + 1, np.int32)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32) if whole else None
    for i, x in enumerate(a):
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
        if whole:
            table[i + 1] = row
    return table if whole else row


def anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The longest run, ascending in both, of places of lines that stand once in a and once in b."""
    once_a, once_b = ({x for x, n in Counter(s.tolist()).items() if n == 1} for s in (a, b))
    at = {x: j for j, x in enumerate(b.tolist()) if x in once_a and x in once_b}
    pairs = [(i, at[x]) for i, x in enumerate(a.tolist()) if x in at]
    tails, ends, before = [], [], []  # least last places of runs by length, the pairs that have them, and what precedes each
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        before.append(ends[n - 1] if n else -1)
        tails[n : n + 1], ends[n : n + 1] = [j], [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def matches(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places that a longest common subsequence joins, ascending.

    Equal starts and ends are joined first. A block of CELLS or fewer is solved exactly; a larger one is parted at lines
    that stand once on either side or, where there are none, in the middle of a and where a common subsequence passes."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        if n < 0:  # a pair that was found before what stands behind it
            yield i, j
            continue
        while i < n and j < m and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        same = 0
        while i < n - same and j < m - same and a[n - same - 1] == b[m - same - 1]:
            same += 1
        todo += [(n - s, -1, m - s, -1) for s in range(1, same + 1)]
        n, m = n - same, m - same
        if i == n or j == m:
            continue
        x, y = a[i:n], b[j:m]
        if len(x) * len(y) <= CELLS:
            t, p, q, found = common_lengths(x, y, True), len(x), len(y), []
            while t[p, q]:
                if x[p - 1] == y[q - 1]:
                    p, q = p - 1, q - 1
                    found.append((i + p, j + q))
                elif t[p - 1, q] >= t[p, q - 1]:
                    p -= 1
                else:
                    q -= 1
            yield from reversed(found)
        elif run := anchors(x, y):
            blocks, p, q = [], i, j
            for u, v in run:
                blocks += [(p, i + u, q, j + v), (i + u, -1, j + v, -1)]
                p, q = i + u + 1, j + v + 1
            todo += [*blocks, (p, n, q, m)][::-1]
        elif len(x) == 1:
            if len(hit := np.flatnonzero(y == x[0])):
                yield i, j + int(hit[0])
        else:
            half = len(x) // 2
            down, up = common_lengths(x[:half], y, False), common_lengths(x[half:][::-1], y[::-1], False)[::-1]
            cut = int(np.argmax(down + up))
            todo += [(i + half, n, j + cut, m), (i, i + half, j, j + cut)]


def script(old: list, new: list) -> list[dict]:
    """Steps that make new of old: a run of lines kept from start on, then lines of old dropped and of new added."""
    number: dict = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in (old, new))
    steps, i, j = [], 0, 0
    step = {"start": 0, "kept": 0, "dropped": 0, "added": []}
    for p, q in [*matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            step["dropped"], step["added"] = p - i, new[j:q]
            steps.append(step)
            step = {"start": p, "kept": 0, "dropped": 0, "added": []}
        step["kept"] += 1
        i, j = p + 1, q + 1
    step["kept"] -= 1  # the pair of ends
    return steps + [step] if step["kept"] else steps


def with_script(rows: DataFrame, old: str, new: str, name: str = "script") -> DataFrame:
    """rows with a shortest edit script from the lines of column old to those of new; null lists are empty.

    Of a pair beyond CELLS that is parted at lines that stand once, the script is correct, but may be longer than the
    shortest. No edits give one step that keeps all; two empty lists give none. All other columns stay."""
    kind = T._parse_datatype_string(SCRIPT)
    rest = [c for c in rows.columns if c != name]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce(col(old), F.array().cast("array<string>")).alias("old"), F.coalesce(col(new), F.array().cast("array<string>")).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = pa.list_(pa.struct([("start", pa.int32()), ("kept", pa.int32()), ("dropped", pa.int32()), ("added", pa.list_(pa.string()))]))
        for batch in batches:
            made = [script(a, b) for a, b in zip(batch["old"].to_pylist(), batch["new"].to_pylist())]
            yield pa.record_batch([batch["row"], pa.array(made, typed)], names=["row", "script"])

    found = packed.mapInArrow(run, T.StructType([packed.schema["row"]]).add("script", kind))
    return found.select(*[F.col("row")[c].alias(c) for c in rest], F.col("script").alias(name))


def applied(old, steps) -> Column:
    """The lines that a script makes of an older list."""
    return F.flatten(F.transform(col(steps), lambda s: F.concat(F.slice(col(old), s["start"] + 1, s["kept"]), s["added"])))


def changes(steps) -> Column:
    """(dropped, added): how many lines a script takes away and puts in."""
    total = lambda f: F.aggregate(F.transform(col(steps), f), F.lit(0), lambda n, x: n + x)
    return F.struct(total(lambda s: s["dropped"]).alias("dropped"), total(lambda s: F.size(s["added"])).alias("added"))


def unified(old, steps, context: int = 1) -> Column:
    """A script as lines: `-` dropped, `+` added, and up to context kept ones on either side, as they are listed."""
    marked = lambda mark, lines: F.transform(lines, lambda x: F.concat(F.lit(mark), x))

    def step(s, i):
        # what a step keeps after the step before's changes, then what it keeps before its own; lines of both are listed once
        after = F.when(i > 0, F.least(s["kept"], F.lit(context))).otherwise(0)
        lead = F.when(F.size(s["added"]) + s["dropped"] > 0, F.least(s["kept"] - after, F.lit(context))).otherwise(0)
        kept = F.concat(F.slice(col(old), s["start"] + 1, after), F.slice(col(old), s["start"] + 1 + s["kept"] - lead, lead))
        return F.concat(marked(" ", kept), marked("-", F.slice(col(old), s["start"] + 1 + s["kept"], s["dropped"])), marked("+", s["added"]))

    return F.flatten(F.transform(col(steps), step))
