"""The overlap graph as shared windows, without listing the pairs inside a window.

Reads that contain the same window of ``k + m - 1`` bases with ``m`` different k-mers all
overlap pairwise. The window is a *hub*: one row per read says what would take a row per
pair. Two kinds of rows make up the whole graph:

* windows in two reads or more. A window that every occurrence continues by the same base
  into another such window says nothing new (that one has all its reads) and is left out;
* pairs of reads that share ``m`` k-mers but no window. A shared k-mer counts for them only
  if the bases around it, which its row carries, agree on too little for a window. Rows
  with the same k-mer and the same bases around it form a class; classes are compared, not
  reads, and reads are looked up for pairs of classes that agree on too little. Such a pair
  of reads is a hub of two.

Rows are ``(hub, part, read_id)``. ``part`` cuts the rows of a hub into pieces of bounded
size, and everything is combined per piece before it is combined per hub, so a window that
a third of all reads contain is never one join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbin.functions.dna import MAX_PACKED_K
from seqbin.operators.indexing import with_group_position
from seqbin.operators.kmers import (
    BUCKET_SCHEMA,
    bucket_chunks,
    chunk_keys,
    deal_to_buckets,
    first_places,
    kmer_tokens,
    run_chunks,
)
from seqbin.operators.overlap import add_ignored, hot_kmers
from seqbin.operators.pieces import PIECES_SCHEMA, deal_pieces
from seqbin.operators.skew import sample_reads, sample_step
from seqbin.staging import stage

#: rows of one hub, or of one class of k-mers, that meet in one join key (two to this power)
PART_BITS = 12
CLASS_BITS = 10
#: window hashes that a read carries
MARKS = 16
#: bases around a k-mer are packed with three bits each
MAX_THRESHOLD = 20

# flags of an occurrence of a k-mer, kept below its left bases
FIRST, WINDOW, CLEAN, FOLLOWED, SPLIT = 1, 2, 4, 8, 16
_FLAG_BITS = 5


def can_cover(k: int, m: int) -> bool:
    """Whether windows can be packed for these parameters."""
    return k <= MAX_PACKED_K and m <= MAX_THRESHOLD


def has_hot_kmers(reads: DataFrame, k: int, hot_limit: int) -> bool:
    """Whether a k-mer stands in more than about ``hot_limit`` reads, by a fixed sample of them.

    If not, the pairs of a read are bounded by its k-mers times that limit.
    """
    step = sample_step(hot_limit)
    return not hot_kmers(kmer_tokens(sample_reads(reads, step), k), hot_limit, step).isEmpty()


# --- windows and bases around k-mers -----------------------------------------------


def _around(chars: np.ndarray, run_at: np.ndarray, run_read: np.ndarray, k: int, m: int) -> dict[str, np.ndarray]:
    """Every k-mer with the ``m - 1`` bases before and the ``m`` bases after it in its run.

    A base is 1 to 4 in three bits, nearest first; 0 where the run has ended. ``valid``:
    a complete window of different k-mers begins here. ``clean``: so do all complete
    windows that contain the k-mer.
    """
    base, at, run_of, key = chunk_keys(chars, run_at, k)
    begin, end = run_at[run_of], run_at[run_of + 1]
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    last = len(base) - 1
    for j in range(m):
        after = at + k + j
        right |= np.where(after < end, base[np.minimum(after, last)] + 1, 0) << (3 * j)
        if j < m - 1:
            before = at - 1 - j
            left |= np.where(before >= begin, base[np.maximum(before, 0)] + 1, 0) << (3 * j)
    complete = at + k + m - 1 <= end
    repeats = _repeats(key, m)
    valid = complete & ~repeats
    dirty = complete & repeats
    clean = ~dirty
    for u in range(1, m):
        # a window that begins u k-mers earlier in the same run
        same = np.zeros(len(at), bool)
        same[u:] = run_of[u:] == run_of[:-u]
        clean[u:] &= ~(same[u:] & dirty[:-u])
    follows = np.zeros(len(at), bool)
    follows[:-1] = valid[1:] & (run_of[1:] == run_of[:-1])
    return {"read": run_read[run_of], "key": key, "left": left, "right": right, "valid": valid, "clean": clean, "follows": follows}


def _repeats(key: np.ndarray, m: int) -> np.ndarray:
    """Whether two of the ``m`` k-mers from each one on are equal."""
    repeats = np.zeros(len(key), bool)
    for p in range(1, m):
        # two equal k-mers p apart inside the window
        equal = np.zeros(len(key) + m, bool)
        if len(key) > p:
            equal[: len(key) - p] = key[:-p] == key[p:]
        for u in range(m - p):
            repeats |= equal[u : u + len(key)]
    return repeats


def dealt_windows(reads: DataFrame, k: int, m: int) -> DataFrame:
    """The windows of :func:`read_windows`, repeats in a read included, as pieces of runs, of ``(read_id)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            base, at, run_of, key = chunk_keys(chars, run_at, k)
            kept = (at + k + m - 1 <= run_at[run_of + 1]) & ~_repeats(key, m)
            read = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield deal_pieces(base, at[kept], run_of[kept], k + m - 1, [read[run_of[kept]]])

    runs = F.filter(F.flatten("mates"), lambda r: F.length(r) >= k + m - 1).alias("runs")
    kept = reads.select("read_id", runs).filter(F.size("runs") > 0)
    return kept.mapInArrow(run, PIECES_SCHEMA)


def _occurrences(chars, run_at, row, k: int, m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different occurrences of k-mers: ``(key, left and flags, right)``."""
    found = _around(chars, run_at, row, k, m)
    flags = WINDOW * found["valid"] + CLEAN * found["clean"] + FOLLOWED * found["follows"]
    flags[first_places(found["read"], found["key"])] += FIRST
    left = found["left"] << _FLAG_BITS | flags
    at = first_places(found["read"], found["key"], found["right"], left)
    return found["read"][at], [found["key"][at], left[at], found["right"][at]]


def _mixed(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """64 bits of hash of a window."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64)
    for _ in range(2):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).astype(np.int64)


def read_marks(reads: DataFrame, k: int, m: int) -> DataFrame:
    """``(read_id, marks)``: the smallest window hashes of each read held in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            found = _around(chars, run_at, row, k, m)
            at = np.flatnonzero(found["valid"])
            h = _mixed(found["key"][at], found["right"][at] & ((1 << 3 * (m - 1)) - 1))
            of = found["read"][at]
            of, h = of[at := first_places(of, h)], h[at]
            h, of = h[order := np.lexsort((h, of))], of[order]
            ends = np.flatnonzero(np.append(of[1:] != of[:-1], len(of) > 0))
            begins = np.append(0, ends[:-1] + 1)[: len(ends)]
            kept = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h)))) < MARKS if len(h) else h > 0
            sizes = np.minimum(ends + 1 - begins, MARKS)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(h[kept], pa.int64()))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[of[ends]]
            yield pa.record_batch([pa.array(ids, pa.int64()), lists], names=["read_id", "marks"])

    one = reads.filter("parts = 1") if "parts" in reads.columns else reads
    runs = F.filter(F.flatten("mates"), lambda r: F.length(r) >= k).alias("runs")
    return one.select("read_id", runs).filter(F.size("runs") > 0).mapInArrow(run, "read_id bigint, marks array<bigint>")


def _packed(reads: DataFrame, k: int, m: int, flag: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            of, (key, left, right) = _occurrences(chars, run_at, row, k, m)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[of]
            yield pa.record_batch(
                [pa.array(x, pa.int64()) for x in (ids, key, left | flag, right)], names=["read_id", "kmer", "left", "right"]
            )

    runs = F.filter(F.flatten("mates"), lambda r: F.length(r) >= k).alias("runs")
    schema = "read_id bigint, kmer bigint, left bigint, right bigint"
    return reads.select("read_id", runs).filter(F.size("runs") > 0).mapInArrow(run, schema)


def shared_occurrences(reads: DataFrame, k: int, m: int) -> DataFrame:
    """``(read_id, kmer, left, right)``: k-mers that occur more than once, with the bases around them."""
    if "parts" in reads.columns:
        rows = _packed(reads.filter("parts = 1"), k, m).unionByName(_packed(reads.filter("parts > 1"), k, m, SPLIT))
    else:
        rows = _packed(reads, k, m)
    several = rows.groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1").select("kmer")
    return stage(rows.join(several, "kmer", "left_semi"), "occurrences")


def _flag(bit: int) -> Column:
    return F.col("left").bitwiseAND(F.lit(bit)) > 0


def _tail(m: int) -> Column:
    return F.col("right").bitwiseAND(F.lit((1 << 3 * (m - 1)) - 1))


def read_windows(occurrences: DataFrame, m: int) -> DataFrame:
    """``(read_id, kmer, tail, next)``: windows of m different k-mers, and the base that follows.

    A window is its first k-mer and the packed ``m - 1`` bases after it. ``next`` is 0 where
    the run ends or the next window repeats a k-mer.
    """
    after = F.when(_flag(FOLLOWED), F.shiftright("right", 3 * (m - 1))).otherwise(0)
    return occurrences.filter(_flag(WINDOW)).select("read_id", "kmer", _tail(m).alias("tail"), after.cast("long").alias("next"))


def read_contexts(occurrences: DataFrame, m: int) -> DataFrame:
    """``(read_id, kmer, left, tail)``: each k-mer of a read once, with the bases around it.

    Without clean surroundings nothing is known about windows, and no base is given.
    """
    bases = [F.when(_flag(CLEAN), c).otherwise(0).cast("long") for c in (F.shiftright("left", _FLAG_BITS), _tail(m))]
    rows = occurrences.filter(_flag(FIRST))
    pick = ["read_id", "kmer", bases[0].alias("left"), bases[1].alias("tail")]
    several = rows.filter(_flag(SPLIT)).select(*pick).groupBy("read_id", "kmer").agg(F.min(F.struct("left", "tail")).alias("c"))
    return rows.filter(~_flag(SPLIT)).select(*pick).unionByName(several.select("read_id", "kmer", "c.left", "c.tail"))


# --- windows and classes of all reads, a bucket of k-mers at a time --------------------

#: kinds of rows of :func:`window_rows`
HUB, CLASS, HOT = 0, 1, 2
_ROWS = "kind int, id bigint, position bigint, total bigint, read_id bigint, kmer bigint, left bigint, tail bigint"
#: rows of a chunk are numbered inside the number of its first bucket
_CHUNK_BITS = 40


def window_rows(reads: DataFrame, k: int, m: int, hot_limit: int) -> DataFrame:
    """Windows in two reads or more and classes of k-mers that can meet, in one table.

    ``HUB``: ``(id, position, read_id)`` as in :func:`shared_windows`, ``position`` the place in
    the window. ``CLASS``: ``(id, position, total, read_id, kmer, left, tail)``, the contexts
    of k-mers that some other occurrence agrees with on too little. ``HOT``: the same without a
    class, for k-mers in more than ``hot_limit`` reads; ``total`` is their number.

    The k-mers are shuffled once, as lists by bucket. All places of a k-mer meet in one task.
    """

    def dealt(rows: DataFrame, flag: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, chars, run_at, row in run_chunks(batches):
                of, (key, left, right) = _occurrences(chars, run_at, row, k, m)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[of]
                yield deal_to_buckets([key, ids, left | flag, right])

        runs = F.filter(F.flatten("mates"), lambda r: F.length(r) >= k).alias("runs")
        return rows.select("read_id", runs).filter(F.size("runs") > 0).mapInArrow(run, BUCKET_SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, columns in bucket_chunks(batches):
            yield from _chunk_rows(first << _CHUNK_BITS, columns, m, hot_limit)

    if "parts" in reads.columns:
        lists = dealt(reads.filter("parts = 1"), 0).unionByName(dealt(reads.filter("parts > 1"), SPLIT))
    else:
        lists = dealt(reads, 0)
    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, _ROWS)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, size, of)``: of every group, and the group of every row."""
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new))), np.cumsum(new) - 1


def _rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns["read_id"])
    none = np.zeros(n, np.int64)
    names = ("id", "position", "total", "read_id", "kmer", "left", "tail")
    values = [pa.array(columns.get(name, none), pa.int64()) for name in names]
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), *values], names=["kind", *names])


def _chunk_rows(base: int, columns: list[np.ndarray], m: int, hot_limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`window_rows` of a chunk of ``(kmer, read_id, left and flags, right)``."""
    order = np.argsort(columns[0])
    kmer = columns[0][order]
    several = np.zeros(len(kmer), bool)
    several[1:] = kmer[1:] == kmer[:-1]
    several[:-1] |= several[1:]
    order = order[several]
    kmer, read, left, right = (c[order] for c in columns)
    tail = right & ((1 << 3 * (m - 1)) - 1)

    at = np.flatnonzero(left & WINDOW)
    after = np.where(left[at] & FOLLOWED, right[at] >> 3 * (m - 1), 0)
    at, after = at[by := np.lexsort((tail[at], kmer[at]))], after[by]
    if len(at):
        start, size, of = _groups(_starts(kmer[at], tail[at]))
        least, most = np.minimum.reduceat(after, start), np.maximum.reduceat(after, start)
        kept = ((size > 1) & ~((least == most) & (least > 0)))[of]
        yield _rows(HUB, id=(base + start[of])[kept], position=(np.arange(len(at)) - start[of])[kept], read_id=read[at[kept]])

    at = np.flatnonzero(left & FIRST)
    clean = left[at] & CLEAN > 0
    rows = [kmer[at], read[at], np.where(clean, left[at] >> _FLAG_BITS, 0), np.where(clean, tail[at], 0), left[at] & SPLIT > 0]
    if rows[-1].any():
        # a k-mer in several rows of a split read counts once
        by = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        rows = [c[by] for c in rows]
        again = ~_starts(rows[0], rows[1], rows[4]) & rows[4]
        rows = [c[~again] for c in rows]
    by = np.lexsort((rows[3], rows[2], rows[0]))
    kmer, read, left, tail = (c[by] for c in rows[:4])
    if not len(kmer):
        return
    _, n_kmer, of_kmer = _groups(_starts(kmer))
    start, size, of = _groups(_starts(kmer, left, tail))
    meets = _can_meet(of_kmer[start], left[start], tail[start], size, m)[of_kmer]
    hot = n_kmer[of_kmer] > hot_limit
    for kind, kept in ((CLASS, meets & ~hot), (HOT, meets & hot)):
        if kept.any():
            total = size[of] if kind == CLASS else n_kmer[of_kmer]
            place = {"id": (base + start[of])[kept], "position": (np.arange(len(kmer)) - start[of])[kept]} if kind == CLASS else {}
            yield _rows(kind, **place, total=total[kept], read_id=read[kept], kmer=kmer[kept], left=left[kept], tail=tail[kept])


def _agreed_bases(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """:func:`_agreed` of arrays."""
    total, still = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for j in range(m - 1):
        x, y = a >> 3 * j & 7, b >> 3 * j & 7
        still &= (x == y) & (x > 0)
        total += still
    return total


def _can_meet(of: np.ndarray, left: np.ndarray, tail: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """Per k-mer, of its classes: whether two of its occurrences can agree on too little for a window.

    Exact for up to two classes, true for more.
    """
    start, classes, _ = _groups(_starts(of))
    itself = (_agreed_bases(left, left, m) + _agreed_bases(tail, tail, m) + 1 < m) & (size > 1)
    met = (classes > 2) | np.logical_or.reduceat(itself, start)
    two = np.flatnonzero(classes == 2)
    a, b = start[two], start[two] + 1
    met[two] |= _agreed_bases(left[a], left[b], m) + _agreed_bases(tail[a], tail[b], m) + 1 < m
    return met


# --- the graph ----------------------------------------------------------------------


def shared_windows(occurrences: DataFrame, m: int) -> DataFrame:
    """``(hub, part, read_id)`` of the windows that say something new."""
    placed = with_group_position(
        read_windows(occurrences, m), ["kmer", "tail"], ["read_id", "next"], "hub", "position", "total", ranges=("next",)
    )
    told_by_next = (F.col("next_min") == F.col("next_max")) & (F.col("next_min") > 0)
    return placed.filter((F.col("total") > 1) & ~told_by_next).select(
        "hub", F.shiftright("position", PART_BITS).alias("part"), "read_id"
    )


def _agreed(a: Column, b: Column, m: int) -> Column:
    """How many bases, nearest first, two packed contexts have in common."""
    total = F.lit(0)
    for j in reversed(range(m - 1)):
        x = F.shiftright(a, 3 * j).bitwiseAND(F.lit(7))
        y = F.shiftright(b, 3 * j).bitwiseAND(F.lit(7))
        total = F.when((x == y) & (x > 0), total + 1).otherwise(0)
    return total


def windowless_pairs(reads: DataFrame, rows: DataFrame, k: int, m: int) -> DataFrame:
    """``(src, dst)`` with ``src < dst``: overlapping pairs, all those that share no window among them.

    ``rows`` are the :func:`window_rows` of ``reads``. Each pair shares ``m`` k-mers or more. A
    pair that does share a window may be listed too, if it also shares ``m`` k-mers outside of
    windows and none of the marked windows. Of the k-mers in very many reads each read leaves
    out its ``m - 1`` hottest; they are counted for the pairs that the others give.
    """
    columns = ["class", "read_id", "kmer", "left", "tail", "position", "total"]
    placed = rows.filter(F.col("kind") == CLASS).withColumnRenamed("id", "class").select(*columns)
    hot = rows.filter(F.col("kind") == HOT).select("read_id", "kmer", "left", "tail", F.col("total").alias("n_est"))
    marked = None
    if not hot.isEmpty():
        hottest = Window.partitionBy("read_id").orderBy(F.desc("n_est"), "kmer")
        marked = stage(hot.withColumn("ignored", F.row_number().over(hottest) < m), "marked-contexts")
        used_too = marked.filter(~F.col("ignored")).select("read_id", "kmer", "left", "tail")
        warm = with_group_position(used_too, ["kmer", "left", "tail"], ["read_id"], "class", "position", "total")
        placed = placed.unionByName(warm.withColumn("class", -1 - F.col("class")).select(*columns))
    placed = placed.withColumn("piece", F.shiftright("position", CLASS_BITS))
    if marked is not None:
        placed = stage(placed, "contexts")
    classes = placed.filter("position = 0").select("class", "kmer", "left", "tail", "total")
    one, two = classes.alias("one"), classes.alias("two")
    little = _agreed(F.col("one.left"), F.col("two.left"), m) + _agreed(F.col("one.tail"), F.col("two.tail"), m) + 1 < m
    same = F.col("one.class") == F.col("two.class")
    met = one.join(two, (F.col("one.kmer") == F.col("two.kmer")) & (F.col("one.class") <= F.col("two.class")) & little)
    met = met.filter(~same | (F.col("one.total") > 1))

    def pieces(side: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.shiftright(F.col(f"{side}.total") - 1, CLASS_BITS))

    met = (
        met.select(F.col("one.class").alias("c"), F.col("two.class").alias("d"), pieces("one").alias("ps"), pieces("two").alias("qs"))
        .select("c", "d", F.explode("ps").alias("p"), "qs")
        .select("c", "d", "p", F.explode("qs").alias("q"))
        .filter((F.col("c") != F.col("d")) | (F.col("p") <= F.col("q")))
    )
    met = stage(met, "met-classes")
    used = met.select(F.inline(F.array(F.struct("c", "p"), F.struct(F.col("d").alias("c"), F.col("q").alias("p"))))).distinct()
    used = used.withColumnsRenamed({"c": "class", "p": "piece"})
    no_marks = F.array().cast("array<bigint>")
    marked_reads = (
        placed.select("class", "piece", "read_id")
        .join(used, ["class", "piece"], "left_semi")
        .join(read_marks(reads, k, m), "read_id", "left")
        .withColumn("marks", F.coalesce("marks", no_marks))
    )
    marked_reads = stage(marked_reads, "marked-reads")
    a = marked_reads.toDF("x", "c", "p", "xm")
    b = marked_reads.toDF("y", "d", "q", "ym")
    inside = (F.col("c") == F.col("d")) & (F.col("p") == F.col("q"))
    once = (F.col("x") != F.col("y")) & (~inside | (F.col("x") < F.col("y")))
    listed = met.join(a, ["c", "p"]).join(b, ["d", "q"]).filter(once & ~F.arrays_overlap("xm", "ym"))
    pairs = (
        listed.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )
    if marked is not None:
        pairs = add_ignored(pairs, marked)
    return pairs.filter(F.col("weight") >= m).select("src", "dst")


def overlap_hubs(reads: DataFrame, k: int, m: int, hot_limit: int = 4096) -> DataFrame:
    """``(hub, part, read_id)``: the overlap graph of ``reads``; two reads overlap iff they share a hub.

    Its size grows with the bases of the reads and with the pairs that share no window.
    """
    if not can_cover(k, m):
        raise ValueError(f"windows need k <= {MAX_PACKED_K} and m <= {MAX_THRESHOLD}")
    rows = stage(window_rows(reads, k, m, hot_limit), "window-rows")
    windows = rows.filter(F.col("kind") == HUB).select(
        F.col("id").alias("hub"), F.shiftright("position", PART_BITS).alias("part"), "read_id"
    )
    return windows.unionByName(pair_hubs(windowless_pairs(reads, rows, k, m)))


def pair_hubs(edges: DataFrame) -> DataFrame:
    """Each pair as a hub of two, with ids below 0."""
    numbered = stage(edges.select("src", "dst", (-1 - F.monotonically_increasing_id()).alias("hub")), "pair-hubs")
    return numbered.select("hub", F.lit(0).cast("long").alias("part"), F.explode(F.array("src", "dst")).alias("read_id"))


# --- what groups and components need --------------------------------------------------


def _to_parts(hubs: DataFrame, per_part: DataFrame, value: str) -> DataFrame:
    """``(hub, part, value)``: the smallest value of each hub, at every part of it."""
    per_hub = per_part.groupBy("hub").agg(F.min(value).alias(value))
    return per_part.select("hub", "part").join(per_hub, "hub")


def hub_stars(hubs: DataFrame) -> DataFrame:
    """``(src, dst)``: each hub's reads tied to its smallest one; the components are the same."""
    smallest = stage(hubs.groupBy("hub", "part").agg(F.min("read_id").alias("src")), "hub-parts")
    tied = hubs.join(_to_parts(hubs, smallest, "src"), ["hub", "part"]).filter("src < read_id")
    return tied.select("src", F.col("read_id").alias("dst")).distinct()


def independent_hubs(hubs: DataFrame) -> DataFrame:
    """``(read_id, seed)``: the same maximal independent set and stars as of the listed pairs.

    A read becomes a seed when its hash is the smallest in all its hubs. A hub has one
    seed at most, so seeds and the reads they cover are found per hub.
    """
    everything = hubs
    still = everything
    rounds: list[DataFrame] = []
    while not still.isEmpty():
        low = stage(still.groupBy("hub", "part").agg(F.min(F.xxhash64("read_id")).alias("low")), "hub-low")
        beaten = F.max((F.xxhash64("read_id") != F.col("low")).cast("int")).alias("beaten")
        seeds = still.join(_to_parts(still, low, "low"), ["hub", "part"]).groupBy("read_id").agg(beaten)
        seeds = stage(seeds.filter("beaten = 0").select("read_id"), "hub-seeds")
        rounds.append(seeds)
        owned = still.join(seeds, "read_id", "left_semi").select("hub").distinct()
        places = low.select("hub", "part").join(owned, "hub")
        gone = stage(still.join(places, ["hub", "part"], "left_semi").select("read_id").distinct(), "hub-covered")
        still = stage(still.join(gone, "read_id", "left_anti"), "hubs-open")
    if not rounds:
        return everything.select("read_id", F.col("read_id").alias("seed"))
    seeds = rounds[0]
    for more in rounds[1:]:
        seeds = seeds.unionByName(more)
    seeds = stage(seeds, "hub-all-seeds")
    owners = everything.join(seeds, "read_id").select("hub", F.col("read_id").alias("seed")).distinct()
    places = everything.select("hub", "part").distinct().join(owners, "hub")
    attached = everything.join(places, ["hub", "part"]).groupBy("read_id").agg(F.min("seed").alias("near"))
    own = seeds.withColumn("own", F.lit(True))
    return attached.join(own, "read_id", "left").select(
        "read_id", F.when(F.col("own"), F.col("read_id")).otherwise(F.col("near")).alias("seed")
    )


def contract_hubs(hubs: DataFrame, stars: DataFrame) -> DataFrame:
    """The graph of the seeds: reads replaced by their seeds, hubs of one seed left out."""
    moved = hubs.join(stars, "read_id").select("hub", F.col("seed").alias("read_id")).distinct()
    placed = with_group_position(stage(moved, "hub-seeds"), ["hub"], ["read_id"], "first", "position", "total")
    return placed.filter("total > 1").select("hub", F.shiftright("position", PART_BITS).alias("part"), "read_id")
