"""What the corpus operators share: tables in the shared folder, Arrow slices and vectorised hashes of words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a single longer text is one step of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a worker, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Called in a worker when a task ends: each empties a cache of its module.
KEPT: list[Callable[[], None]] = []

_OPEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, only a local master gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/lodestack-shared").rstrip("/")


class Workspace:
    """Parquet tables in the shared folder that cut lineage and outlive lost executors.

    Results may still read them lazily, so they go when the driver ends (or by drop())."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/lodestack-{name}-{uuid.uuid4().hex}"
        _OPEN.append((spark, self.path))

    def table(self, name: str, df: DataFrame, **options) -> DataFrame:
        df.write.options(**({"compression": "zstd"} | options)).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release() -> None:
    """Deletes the tables of all workspaces."""
    while _OPEN:
        spark, path = _OPEN.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, path)


def set_aside(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The used columns, and all others in one column _rest, where no name of theirs can clash with ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], *([F.struct(*rest).alias("_rest")] if rest else []))


def restored(names: list[str], used: tuple[str, ...]) -> list[Column]:
    """The columns of those names of a frame that set_aside made."""
    return [F.col(c) if c in used else F.col("_rest")[c].alias(c) for c in names]


def with_columns_by(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: T.StructType) -> DataFrame:
    """docs with the columns that run puts behind those of its batches; only text is seen by its name, as others may have
    names with dots, which functions over batches don't take."""
    own = docs.drop(*added.names)
    aside = set_aside(own, ("text",))
    return aside.mapInArrow(tidy(run), T.StructType(aside.schema.fields + added.fields)).select(*restored(own.columns, ("text",)), *added.names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_train(doc_id="doc_id", skip: int = 1):
    """crc32 of the id as text, modulo 5, isn't skip; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) != skip


def bound_batches(limit: int = BATCH_BYTES) -> None:
    """Asks the session for Arrow batches of at most limit bytes; a lower setting stays. A task holds one on each side."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > limit:
        spark.conf.set(BATCH_SETTING, str(limit))


def give_back() -> None:
    """Empties caches and returns freed memory to the system: workers outlive tasks, and a driver its models' training."""
    for forget in KEPT:
        forget()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over bounded batches; what a task has kept or freed goes back to the system, as workers outlive their tasks."""
    bound_batches()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most limit bytes of text, or one row."""
    offsets = text_buffers(batch[column])[0]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and their bytes end to end; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n, 1 << 16), x, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers


def _forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT.append(_forget_powers)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums: equal bytes have equal hashes wherever they stand."""
    pw, inv = powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTE[body] * pw[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_spans(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and how many words stand before each text."""
    solid = np.zeros(len(body) + 2, bool)
    solid[1:-1] = ~SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | first))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words stand before each text."""
    offsets, body = text_buffers(column)
    starts, ends, before = word_spans(offsets, body)
    return span_hashes(_LOWER[body] if lower else body, starts, ends), before
