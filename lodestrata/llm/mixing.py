"""Mixing sources to target weights with a low-discrepancy schedule.

Targets are exact (integers until the last division); a source takes its target to the word, rounded so that all together
take the total.  The mix is a sequence of slots of ``block`` words each, a source's last one of what is left of its words.
Slot n is the point n * F(m - 1) mod F(m) of the golden-ratio lattice (Fibonacci numbers, F(m) the least that is enough),
mapped through the sources' cumulative counts of slots; points beyond these are left out.  The lattice meets each point
once, so every source gets its count, and any prefix of the sequence holds each source within a few slots of its share.  A
slot's rank among its source's slots is the block it takes: the source's documents are laid end to end in a seeded shuffle,
the line repeats as often as the target asks, and is cut into blocks.  Slots and blocks are joined by (source, rank).

Scale: one source may hold any share of the rows.  The place of a document in its source's line is a prefix sum over hash
buckets of bounded size and then inside a bucket; a slot's rank likewise over chunks of slots.  No window covers a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.llm.shared import WORD, row_hash, unused, word_count, written

WEIGHTS = (1, 2, 3)
CAP = 3
#: Largest block in words; smaller where the corpus has fewer than ``SLOTS`` such blocks.
BLOCK = 1024
SLOTS = 1 << 17
#: Sources are one row each on the driver; more than this many is refused, not cut.
MAX_SOURCES = 200_000
ROWS_PER_BUCKET = 1024
CHUNK = 1 << 16


def fill_targets(sizes: list[int], weights: list[int], total: int, cap: int = CAP) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``cap`` times its size, the excess reshared by weight."""
    out: dict[int, Fraction] = {}
    left = sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weights[i]))
    rest, weight = Fraction(total), sum(weights)
    for n, i in enumerate(left):
        level = rest / weight
        if cap * sizes[i] > level * weights[i]:
            return [out[j] if j in out else level * weights[j] for j in range(len(sizes))]
        out[i] = Fraction(cap * sizes[i])
        rest -= out[i]
        weight -= weights[i]
    return [out[j] for j in range(len(sizes))]


def whole_words(targets: list[Fraction]) -> list[int]:
    """Integers, each less than one from its target and with the same sum, where that is an integer."""
    out, done, sum_ = [], 0, Fraction(0)
    for t in targets:
        sum_ += t
        out.append(math.floor(sum_) - done)
        done += out[-1]
    return out


def _lines(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, source, size, th, h): what the plan needs of each row; th digests the row, h is the shuffle key."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        row_hash(docs).alias("th"),
    ).withColumn("h", F.xxhash64("doc_id", "th", F.lit(seed)))


def schedule(counts: list[int], docs: DataFrame) -> DataFrame:
    """(slot, no, rank): source ``no`` has ``counts[no]`` slots, spread evenly."""
    ends = np.cumsum(np.array(counts, np.int64))
    slots = int(ends[-1]) if counts else 0
    step, size = 1, 1
    while size < slots:
        step, size = size, step + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(0))
            first = int(n[0]) if len(n) else 0  # a batch is a short range: no product below leaves 64 bits
            point = (first * step % size + (n - first) * step % size) % size
            own = np.flatnonzero(point < slots)
            no = np.searchsorted(ends, point[own], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(n[own]), pa.array(no.astype(np.int32))], names=["slot", "no"])

    dealt = docs.sparkSession.range(size if slots else 0).toDF("slot").mapInArrow(run, "slot long, no int").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    before = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("no", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1
    return dealt.withColumn("inside", inside).join(base, ["no", "chunk"]).select("slot", "no", (F.col("base") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The plan of the mix: (per row, fills).

    Per row: uid, doc_id, th, source, size, source_size, target, taken, first_slot (null if nothing is taken).  Fills:
    (slot, uid, start, end), the words of a row that a slot takes, a row's words counted on through its repeats.

    Defined cases: null sources are one source, the last; a null text has size 0; a source without words has target 0;
    repeated rows are separate rows; an empty table gives none; other columns only tell rows apart.
    """
    spark = docs.sparkSession
    rows = written(_lines(docs, id_col, source_col, text_col, seed).withColumn("uid", F.monotonically_increasing_id()), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.s for r in found]
    total = sum(sizes)
    targets = fill_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], total)
    block = max(1, min(BLOCK, total // SLOTS))
    words = whole_words(targets)
    info = spark.createDataFrame(
        [(i, r.source, r.s, float(t), n) for i, (r, t, n) in enumerate(zip(found, targets, words))],
        "no int, source string, source_size long, target double, words long",
    )
    known = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["source"])).drop(info["source"])

    bits = max(0, (-(-sum(r.n for r in found) // ROWS_PER_BUCKET) - 1).bit_length())
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    sized = known.filter("size > 0").withColumn("bucket", bucket)
    before = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.groupBy("no", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("no", "bucket").orderBy("h", "doc_id", "size", "th", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["no", "bucket"])
    placed = placed.select("uid", "no", "size", "source_size", "words", (F.col("base") + F.col("inside")).alias("at"))

    plan = written(schedule([-(-n // block) for n in words], docs), "schedule")
    line = (
        placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
        .withColumn("from", F.col("turn") * F.col("source_size") + F.col("at"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
        .filter("from < to")
    )
    cut = line.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    start, end = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    shift = F.col("turn") * F.col("size") - F.col("from")
    fills = cut.join(plan, ["no", "rank"]).select("slot", "uid", (start + shift).alias("start"), (end + shift).alias("end"))
    fills = written(fills, "fills")
    taken = fills.groupBy("uid").agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.min("slot").alias("first_slot"))
    per = known.join(taken, "uid", "left").select(
        "uid", "doc_id", "th", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot"
    )
    return per, fills


def mixture_report(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) for each row; see :func:`mix` for the defined cases.

    first_slot is the place in the schedule at which the row first comes, null where the mix takes nothing of it.
    """
    return mix(docs, **columns)[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as its words are taken.

    A row's last turn may take only its first words; it then has these, joined by one space.  Rows that are not taken go.
    Rows equal in all columns count together, rows that differ in any (the source, say) each for itself.  Each partition is
    in the order of the schedule.
    """
    per, _ = mix(docs, id_col, source_col, text_col)
    id_, th, taken, size, slot, turn = unused(docs, "_id", "_th", "_taken", "_size", "_slot", "_turn")
    again = per.filter("taken > 0").groupBy("doc_id", "th").agg(F.sum("taken"), F.max("size"), F.min("first_slot"))
    a, b = unused(docs, "_a", "_b")
    again = again.toDF(a, b, taken, size, slot)
    once = docs.withColumns({id_: F.col(id_col).cast("long"), th: row_hash(docs)}).dropDuplicates([id_, th])
    joined = once.join(again, F.col(id_).eqNullSafe(F.col(a)) & (F.col(th) == F.col(b))).sortWithinPartitions(slot, id_, th)
    turns = joined.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size)))))
    left = F.col(taken) - (F.col(turn) - 1) * F.col(size)
    text = F.col(text_col).cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return turns.withColumn(text_col, F.when(left >= F.col(size), text).otherwise(cut)).select(*docs.columns)
