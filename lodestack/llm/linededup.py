"""Line dedup: a suffix array over line ids by distributed prefix doubling, its longest common prefixes, the maximal runs
of lines that stood before, and their later copies deleted.

Lines that occur once can't be part of a repeat, so only runs of repeated lines are sorted. Level by level the
suffixes that start in them are ranked by their first 1, 2, 4, ... lines: the ranks of two halves, sorted in ranges
over the cluster, give those of the double length, until no suffixes of equal rank go on. The ranks of all levels tell
how many lines neighbours in the array share, and a pass over the array what each suffix shares with an earlier one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, restored, set_aside, tidy
from .mixing import WORD

#: Words that a repeated run of lines must have: every run that holds a word.
MIN_WORDS = 1


def ranked(keys: DataFrame, columns: list[str], work: Workspace, name: str) -> DataFrame:
    """keys with rank: numbers in the order of columns, by a range partitioning and a sort inside each range."""
    n = partitions(keys.sparkSession)
    ordered = keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return work.table(name, ordered.withColumn("rank", F.monotonically_increasing_id()))


def text_keys(text: Column, prefix: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(i), text).alias(f"{prefix}{i}") for i in (1, 2)]


def suffix_array(lines: DataFrame, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The ranks of all suffixes by their first 1, 2, 4, ... lines, and by all, as (seq, pos, rank, left).

    lines are (seq, pos, rank, left): repeated lines, with the lines up to where their run of repeated lines ends. A
    suffix that ends sorts before one that goes on. It is done when no suffixes of equal rank go on."""
    levels, k = [lines.select("seq", "pos", "rank", "left")], 0
    while not levels[k].groupBy("rank").agg(F.count("*").alias("c"), F.max("left").alias("m")).where((F.col("c") > 1) & (F.col("m") > 1 << k)).isEmpty():
        ahead = Window.partitionBy("seq").orderBy("pos").rangeBetween(1 << k, 1 << k)
        r2 = F.when(F.col("left") > 1 << k, F.first("rank").over(ahead)).otherwise(-1)
        pairs = work.table(f"pairs{k}", levels[k].select("seq", "pos", "left", F.col("rank").alias("r1"), r2.alias("r2")))
        k += 1
        names = ranked(pairs.select("r1", "r2").distinct(), ["r1", "r2"], work, f"rank{k}")
        levels.append(work.table(f"level{k}", pairs.join(names, ["r1", "r2"]).select("seq", "pos", "rank", "left")))
    return levels, levels[-1]


def common_prefixes(levels: list[DataFrame], array: DataFrame, work: Workspace) -> DataFrame:
    """(top, rank, seq, pos, lcp): the array inside each group of suffixes that share two lines, and how many lines each
    shares with the one before it (the first of a group: 0), by halving steps over the ranks of all levels."""
    two = levels[1].where("left > 1").select("seq", "pos", F.col("rank").alias("top"))
    shared = two.groupBy("top").count().where("count > 1").select("top")
    before = Window.partitionBy("top").orderBy("rank", "seq", "pos")
    pairs = array.select("seq", "pos", "rank").join(two.join(shared, "top"), ["seq", "pos"])
    pairs = work.table("neighbours", pairs.select("top", "rank", "seq", "pos", F.lag("seq").over(before).alias("pseq"), F.lag("pos").over(before).alias("ppos"), F.lit(0).alias("lcp")))
    for k in reversed(range(len(levels))):
        full = levels[k].where(F.col("left") >= 1 << k)  # others are ranked with their ends
        mine = full.select(F.col("seq").alias("s1"), F.col("pos").alias("p1"), F.col("rank").alias("ra"))
        other = full.select(F.col("seq").alias("s2"), F.col("pos").alias("p2"), F.col("rank").alias("rb"))
        found = pairs.join(mine, (F.col("seq") == F.col("s1")) & (F.col("pos") + F.col("lcp") == F.col("p1")), "left")
        found = found.join(other, (F.col("pseq") == F.col("s2")) & (F.col("ppos") + F.col("lcp") == F.col("p2")), "left")
        lcp = (F.col("lcp") + F.when(F.col("ra") == F.col("rb"), 1 << k).otherwise(0)).alias("lcp")
        pairs = work.table(f"lcp{k}", found.select("top", "rank", "seq", "pos", "pseq", "ppos", lcp))
    return pairs.select("top", "rank", "seq", "pos", "lcp")


def longest_earlier(prefixes: DataFrame) -> DataFrame:
    """(seq, pos, le): the longest run from each suffix of common_prefixes on that also starts further up in the corpus.

    One pass in the array's order: what waits has rising places and rising prefixes, so it is no deeper than the
    longest run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: list[tuple] = []  # ((seq, pos), lines shared with the one below)
        group = None
        for batch in batches:
            out = []
            for top, s, p, lcp in zip(*(batch[c].to_pylist() for c in ("top", "seq", "pos", "lcp"))):
                if top != group:
                    out += [(*at, shared) for at, shared in waits]
                    waits.clear()
                    group = top
                here = (s, p)
                while waits and (here < waits[-1][0] or lcp <= waits[-1][1]):
                    at, shared = waits.pop()
                    out.append((*at, max(shared, lcp) if here < at else shared))
                    lcp = min(shared, lcp) if here < at else lcp
                waits.append((here, lcp))
            yield packed(out)
        yield packed([(*at, shared) for at, shared in waits])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["seq", "pos", "le"])

    ordered = prefixes.repartition("top").sortWithinPartitions("top", "rank", "seq", "pos").select("top", "seq", "pos", "lcp")
    return ordered.mapInArrow(tidy(run), "seq long, pos int, le int")


def maximal_runs(lines: DataFrame, work: Workspace) -> DataFrame:
    """(seq, pos, le, words): the runs of repeated lines that stood before and can't be made longer at either end.

    lines are (seq, pos, w, rank, left)."""
    levels, array = suffix_array(lines, work)
    first = lines.groupBy("rank").agg(F.min(F.struct("seq", "pos")).alias("e"))
    first = work.table("earliest", first)  # so that both sides of the join are dealt for it, and a hot line can be split
    one = lines.join(first, "rank").select("seq", "pos", "w", ((F.col("seq") != F.col("e.seq")) | (F.col("pos") != F.col("e.pos"))).cast("int").alias("one"))
    if len(levels) > 1:
        longer = longest_earlier(common_prefixes(levels, array, work))
        one = one.join(longer, ["seq", "pos"], "left").withColumn("le", F.greatest("one", F.coalesce("le", F.lit(0))))
    else:
        one = one.withColumnRenamed("one", "le")
    line = Window.partitionBy("seq").orderBy("pos")
    known = one.withColumn("cum", F.sum("w").over(line)).withColumn("prev", F.first("le").over(line.rangeBetween(-1, -1)))
    known = work.table("known", known.select("seq", "pos", "w", "cum", "le", "prev"))
    ends = known.select("seq", F.col("pos").alias("end"), F.col("cum").alias("to"))
    runs = known.where((F.col("le") > 0) & ~F.col("prev").eqNullSafe(F.col("le") + 1)).withColumn("end", F.col("pos") + F.col("le") - 1)
    return work.table("runs", runs.join(ends, ["seq", "end"]).select("seq", "pos", "le", (F.col("to") - F.col("cum") + F.col("w")).alias("words")))


def deletions(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """(t1, t2, doc_id, gone): which lines go from each different text's first document; a key of all texts.

    gone is null where nothing goes. Copies of a text aren't among the rows: all of a copy goes, if it has
    min_words."""
    spark = docs.sparkSession
    pieces = F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("l1"), F.xxhash64(F.lit(2), x).alias("l2"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text"), "t"), pieces.alias("pieces"))
    rows = work.table("rows", rows)
    first = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("t1"), F.col("t2")]
    seqs = first.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    seqs = work.table("seqs", seqs)
    mine = seqs.withColumnsRenamed({"t1": "_1", "t2": "_2", "doc_id": "_id"})
    owned = rows.join(mine, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    lines = work.table("lines", owned.select("seq", F.posexplode("pieces").alias("pos", "p")).select("seq", "pos", "p.l1", "p.l2", "p.w").distinct())
    work.drop("rows")
    twice = lines.groupBy("l1", "l2").count().where("count > 1").select("l1", "l2")
    ranks = ranked(twice, ["l1", "l2"], work, "rank0")
    line = Window.partitionBy("seq").orderBy("pos")
    placed = lines.join(ranks, ["l1", "l2"]).select("seq", "pos", "w", "rank").withColumn("island", F.col("pos") - F.row_number().over(line))
    left = (F.max("pos").over(Window.partitionBy("seq", "island")) - F.col("pos") + 1).alias("left")
    runs = maximal_runs(work.table("level0", placed.select("seq", "pos", "w", "rank", left)), work).where(F.col("words") >= min_words)
    # runs of a text end no earlier than those that start before them, so each needs to tell only what lies behind the last
    behind = F.greatest("pos", F.coalesce(F.lag(F.col("pos") + F.col("le")).over(line), F.lit(0)))
    new = runs.select("seq", behind.alias("start"), (F.col("pos") + F.col("le") - 1).alias("end")).where("start <= end")
    gone = new.select("seq", F.explode(F.sequence("start", "end")).alias("pos")).groupBy("seq").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return work.table("gone", seqs.join(gone, "seq", "left").select("t1", "t2", F.col("doc_id").alias("_id"), "gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, with text as it is left, n_lines before and n_deleted; ones of those names are replaced.

    Lines are parted by \\n. A run of lines inside a text with min_words words or more (together) that stood before,
    in a text of a smaller doc_id or further up in the same one, is deleted; overlapping runs are deleted together.
    Null ids come last, other ties by a hash of the text. Rows with one id and text are one document. A text of which
    no line is left is empty. Null texts stay null, with 0 lines. An empty table gives no rows."""
    work = Workspace(docs.sparkSession, "lines")
    gone = deletions(docs, work, min_words)
    own = docs.drop("n_lines", "n_deleted")
    keyed = set_aside(own, ("doc_id", "text")).select("*", F.xxhash64(F.lit(1), "text").alias("_t1"), F.xxhash64(F.lit(2), "text").alias("_t2"))
    joined = keyed.join(gone, (F.col("text").isNotNull()) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    copy = ~F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.regexp_count("text", F.lit(WORD)) >= min_words)
    split = joined.withColumns({"_lines": F.split("text", "\n", -1), "_copy": copy})
    # places left are found by hashing and lines fetched by place, so the work is linear in a text's lines
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    none = F.array().cast("array<int>")
    left = split.withColumn("_left", F.when(F.col("_copy"), none).when(F.col("gone").isNull(), places).otherwise(F.array_except(places, F.col("gone"))))
    text = F.when(F.col("text").isNull() | (F.size("_left") == F.size("_lines")), F.col("text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    columns = [text.alias("text") if c == "text" else column for c, column in zip(own.columns, restored(own.columns, ("doc_id", "text")))]
    return left.select(*columns, n.alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines") - F.size("_left")).alias("n_deleted"))
