"""Sequenced changes: a stateful stream applies each client's numbered changes in order and jumps gaps that expired.

The state of a client is what waits (by number), the next number due and the values now; clients are dealt by a hash to
buckets of a bounded number of clients, and a bucket is what the state is kept by. Every batch is a start of the streaming
query on one checkpoint; a clock row of the batch reaches every client known before it, so that gaps expire where nothing
else arrives."""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from .common import Workspace, partitions

#: Days that the first of a client's waiting rows waits for the numbers before it.
PATIENCE = 3
#: Waiting rows of a bucket that a task keeps in memory; of further ones it keeps number and day, and their rows in the state.
KEEP = 10_000
#: Clients of a bucket, about: as many share each read and write of state.
BUCKET = 200
#: The clock after the last batch, which no wait outlasts.
END = 2**31 - 1 - 2**16
#: State needs RocksDB. A start is one batch, so a task closes its store when it ends: what earlier starts had open would
#: fill disk and memory. Memory is bounded a worker, and small batches write changes instead of whole files.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Applier(StatefulProcessor):
    """Applies what is due, holds what is early, rejects what is late or a second of its number.

    Of two rows of one number in one batch, the first by day and id stays. Since only that depends on the order of a
    batch's rows, they are taken as they come, and what is due is applied once all have been seen. The state of a
    client is its next number, its values now and its rows that wait. Every read and write of state is a call to the
    JVM, so the clients of a bucket lie in two lists, read and written at once; what waits beyond the rows that a task
    keeps in memory lies in a map, row by row."""

    def __init__(self, values: T.StructType, batch: int, patience: int = PATIENCE, keep: int = KEEP, last: bool = False):
        self.values, self.batch, self.patience, self.keep, self.last = values, batch, patience, keep, last
        self.out = Row("client_id", "change_id", "n", "op", "status", "batch", "missed", *values.names)
        self.nothing = (None,) * len(values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        due = T.StructType().add("client_id", "long").add("next", "long")
        waits = T.StructType().add("client_id", "long").add("n", "long")
        row = T.StructType().add("change_id", "long").add("op", "string").add("day", "integer")
        row = T.StructType(row.fields + self.values.fields)
        self.now = handle.getListState("now", T.StructType(due.fields + self.values.fields))
        self.held = handle.getListState("held", T.StructType(waits.fields + row.fields))
        self.far = handle.getMapState("far", waits, row)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """rows are (bucket, client, clock, change); a clock row has no change. All of a batch tell the same clock. In the
        last start the waits that its batch leaves end too, as the next batch, so that no start has to open all state for them."""
        batch = self.batch
        now, held = list(self.now.get()), list(self.held.get())
        self.room = self.keep - len(held)  # for further rows in memory
        clients = {c: _Client(self, c, due, tuple(values)) for c, due, *values in now}
        for c, n, *row in held:
            clients[c].days[n], clients[c].rows[n] = row[2], tuple(row)
        if self.far.exists():
            for (c, n), row in self.far.iterator():
                clients[c].days[n] = row[2]
        told = {}
        for *_, c, clock, change in rows:
            if c not in told:
                told[c] = clients[c] = clients.get(c) or _Client(self, c, 1, self.nothing)
                yield from told[c].expire(clock, batch)
            if change is not None:
                yield from told[c].take(change, batch)
        for client in told.values():
            yield from client.pop(0, batch)
        for client in clients.values() if self.last else ():
            yield from client.expire(END, batch + 1)
        self.save(self.now, now, [(c, x.next, *x.values) for c, x in clients.items()])
        self.save(self.held, held, [(c, n, *row) for c, x in clients.items() for n, row in x.rows.items()])

    def save(self, state: ListState, before: list[tuple], after: list[tuple]) -> None:
        if after and after != before:
            state.put(after)
        elif before and not after:
            state.clear()

    def close(self) -> None:
        pass


class _Client:
    """One client in one batch."""

    __slots__ = ("of", "key", "next", "values", "days", "rows", "order")

    def __init__(self, of: Applier, key: int | None, due: int, values: tuple):
        self.of, self.key, self.next, self.values = of, key, due, values
        self.days: dict[int, int] = {}  # of every number that waits
        self.rows: dict[int, tuple] = {}  # of those in memory; the others are in the map
        self.order: dict[int, tuple] = {}  # of this batch's numbers

    def expire(self, clock: int | None, batch: int) -> Iterator[Row]:
        """Jumps to the least number that waits, as long as the first day that waits is over by the clock."""
        patience = self.of.patience
        if clock is None or not self.days or min(self.days.values()) + patience > clock:
            return
        numbers, days = sorted(self.days, reverse=True), [(d, n) for n, d in self.days.items()]
        heapq.heapify(days)
        while True:
            while days and days[0][1] not in self.days:
                heapq.heappop(days)
            while numbers and numbers[-1] not in self.days:
                numbers.pop()
            if not days or days[0][0] + patience > clock:
                return
            missed, self.next = numbers[-1] - self.next, numbers[-1]
            yield from self.pop(missed, batch)

    def take(self, row: dict, batch: int) -> Iterator[Row]:
        n, change, op = row["n"], row["change_id"], row["op"]
        if n < self.next:
            yield self.rejected(change, n, op, batch)
            return
        order = (row["day"], change is None, change or 0, row["tie"], op)
        if n in self.days:
            before = self.order.get(n)
            if before is None or before[:4] <= order[:4]:
                yield self.rejected(change, n, op, batch)
                return
            yield self.rejected(None if before[1] else before[2], n, before[4], batch)
        kept = (change, op, row["day"], *(row[c] for c in self.of.values.names))
        if n in self.rows:
            self.rows[n] = kept
        elif n not in self.days and self.of.room > 0:
            self.rows[n] = kept
            self.of.room -= 1
        else:
            self.of.far.updateValue((self.key, n), kept)
        self.order[n], self.days[n] = order, row["day"]

    def pop(self, missed: int, batch: int) -> Iterator[Row]:
        """Applies the numbers in a row from next on."""
        while self.next in self.days:
            n = self.next
            row = self.rows.pop(n, None)
            if row is None:
                row = self.of.far.getValue((self.key, n))
                self.of.far.removeKey((self.key, n))
            else:
                self.of.room += 1
            del self.days[n]
            op, new = row[1], tuple(row[3:])
            if op == "I":
                self.values = new
            elif op == "U":
                self.values = tuple(b if a is None else a for a, b in zip(new, self.values))
            elif op == "D":
                self.values = self.of.nothing
            self.next += 1
            yield self.of.out(self.key, row[0], n, op, "applied", batch, missed, *self.values)
            missed = 0

    def rejected(self, change_id: int | None, n: int, op: str | None, batch: int) -> Row:
        return self.of.out(self.key, change_id, n, op, "rejected", batch, 0, *self.of.nothing)


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards with its own again."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dense_ranks(rows: DataFrame, key: str, order: str, name: str, work: Workspace) -> DataFrame:
    """rows with name: the dense rank of order within key, null last; a null key is a key of its own.

    The different pairs are sorted in ranges over all tasks, so no key has to fit into one. A number is the place in
    its range less where the key begins there, and what the key has in the ranges before: one row a key and range."""
    pairs = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o")).distinct()
    by = [F.col("_k").asc_nulls_last(), F.col("_o").asc_nulls_last()]
    placed = pairs.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = work.table("ranks", placed.select("*", F.shiftright("_at", 33).alias("_part")))
    sizes = placed.groupBy("_k", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("_k").alias("_bk"), F.col("_part").alias("_bp"), (F.col("_from") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_from"))
    ranks = placed.join(begins, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_part") == F.col("_bp"))).select("_k", "_o", (F.col("_at") - F.col("_from") + 1).alias(name))
    return rows.join(ranks, rows[key].eqNullSafe(ranks["_k"]) & rows[order].eqNullSafe(ranks["_o"])).drop("_k", "_o")


def apply_changes(changes: DataFrame, batches: int, values: Sequence[str] = ("city", "balance"), patience: int = PATIENCE, keep: int = KEEP) -> DataFrame:
    """client_id, change_id, n, op, status, batch, missed, the values afterwards and current: one row a row of changes.

    changes needs client_id, change_id, n (from 1 on), day, batch (1 to batches), op, tie (which orders rows equal in
    day and id) and the values; other columns are ignored. For each batch a start of the query gets its changes and a
    clock row for every client of an earlier batch, with the latest day of earlier batches; the last start then lets
    all waits end, as batch batches + 1. I sets values, U those that aren't null, D none; other ops apply without
    effect. current marks a client's last applied row, unless that is a D. A null client is one of its own; rows with
    a null n, day or batch are no changes and go. Without rows there is no result.

    Files of batches, state and results lie in a new folder under the shared one; a start that is lost with its
    executors is done again from the checkpoint. To the driver come one row a batch."""
    spark = changes.sparkSession
    work = Workspace(spark, "changes")
    kinds = T.StructType([changes.schema[c] for c in values])
    key, batch = F.col("client_id").cast("long").alias("client_id"), F.col("batch").cast("int").alias("batch")
    change = F.struct(F.col("n").cast("long").alias("n"), F.col("day").cast("int").alias("day"), F.col("change_id").cast("long").alias("change_id"), F.col("op").cast("string").alias("op"), F.col("tie").cast("long").alias("tie"), *values)
    rows = changes.where("n IS NOT NULL AND day IS NOT NULL AND batch IS NOT NULL").select(key, change.alias("change"), batch)
    rows.repartition("batch", F.pmod(F.xxhash64("change"), F.lit(partitions(spark)))).write.partitionBy("batch").option("compression", "zstd").parquet(f"{work.path}/rows")
    rows = work.read("rows", rows)
    known = work.table("known", rows.groupBy("client_id").agg(F.min("batch").alias("first")))
    latest = {r["batch"]: r["day"] for r in rows.groupBy("batch").agg(F.max("change.day").alias("day")).collect()}
    buckets = max(partitions(spark), -(-known.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).alias("bucket")
    fed = T.StructType().add("bucket", "long").add("client_id", "long").add("clock", "integer").add("change", rows.schema["change"].dataType)
    out = T.StructType().add("client_id", "long").add("change_id", "long").add("n", "long").add("op", "string").add("status", "string").add("batch", "integer").add("missed", "long")
    out = T.StructType(out.fields + kinds.fields)
    path = {k: f"{work.path}/{k}" for k in ("fed", "state", "out")}
    with settings(spark, SETTINGS):
        for b in range(1, batches + 1):
            clock = max((d for k, d in latest.items() if k < b), default=None)
            told = known.where(F.col("first") < b).select("client_id", F.lit(None).cast(fed["change"].dataType).alias("change"))
            both = rows.where(F.col("batch") == b).select("client_id", "change").unionByName(told)
            both.select(bucket, "client_id", F.lit(clock).cast("int").alias("clock"), "change").write.mode("append").parquet(path["fed"])
            stream = spark.readStream.schema(fed).parquet(path["fed"])
            done = stream.groupBy("bucket").transformWithState(Applier(kinds, b, patience, keep, b == batches), out, "append", "none")
            done.writeStream.format("parquet").option("checkpointLocation", path["state"]).trigger(availableNow=True).start(path["out"]).awaitTermination()
    work.drop("rows")
    found = spark.read.schema(out).parquet(path["out"])
    applied = found.where("status = 'applied'")
    last = applied.groupBy("client_id").agg(F.max(F.struct("n", "op")).alias("l")).select(F.col("client_id").alias("_k"), F.col("l.n").alias("_n"), (~F.col("l.op").eqNullSafe("D")).alias("_live"))
    marked = applied.join(last.hint("merge"), F.col("client_id").eqNullSafe(F.col("_k")) & (F.col("n") == F.col("_n")), "left")
    every = marked.select(*out.names, F.coalesce("_live", F.lit(False)).alias("current")).unionByName(found.where("status <> 'applied'").withColumn("current", F.lit(False)))
    return every.select(*out.names, "current")


def epoch_day(at: Column) -> Column:
    return F.unix_date(F.to_date(at))
