"""Read pairs from an inverted index whose entries carry run links.

A run of k-mers that two reads share in the same order is told by its two ends, so of all
pairs of reads at a k-mer only those count whose bases before it, or after it, differ (or are
unknown). The reads of a k-mer are sorted by these two bases: the pairs that count are then
ranges, and the others, nearly all at a k-mer inside a text that many reads have, are never
formed. An end row adds ``rank + 1``, a start row subtracts ``rank``; the sum of a pair is the
number of k-mers it shares.

Three shuffles: k-mers to the index, as pieces of runs (:mod:`seqbin.operators.pieces`), index
entries to where their pairs are formed, ends of runs, as lists by bucket, to where they are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.operators.kmers import (
    BUCKET_SCHEMA,
    UNLINKED,
    bucket_chunks,
    deal_to_buckets,
    kmer_tokens,
    pack_places,
    run_chunks,
)
from seqbin.operators.pieces import PIECES_SCHEMA, PieceChunk, deal_pieces, piece_chunks

#: rows of one hot k-mer that meet in one entry
BLOCK_ROWS = 1024
#: pairs of one entry, and pairs formed at a time
ENTRY_PAIRS = 2_000_000
#: entries of a chunk are numbered inside its number
_ENTRY_BITS = 32
_INDEX = "entry bigint, cut int, kmers array<bigint>, reads array<bigint>, links array<bigint>"


def _dealt_tokens(reads: DataFrame, k: int) -> DataFrame:
    """:func:`seqbin.operators.kmers.kmer_tokens` as pieces, of ``(read_id, rank)`` and the bases around."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            base, at, run_of, row, _, link = pack_places(chars, run_at, row, k)
            read = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield deal_pieces(base, at, run_of, k, [read, link >> 6], link & 63)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, read, link = (batch.column(name).to_numpy() for name in ("kmer", "read_id", "link"))
                base = (key[:, None] >> 2 * np.arange(k)[::-1] & 3).ravel()
                row = np.arange(len(key))
                yield deal_pieces(base, row * k, row, k, [read, link >> 6], link & 63)

    # a read without id is in no pair
    known = reads.filter("read_id is not null")
    one = known.filter("parts = 1") if "parts" in reads.columns else known
    runs = F.filter(F.flatten("mates"), lambda run: F.length(run) >= k).alias("runs")
    dealt = one.select("read_id", runs).filter(F.size("runs") > 0).mapInArrow(whole, PIECES_SCHEMA)
    if "parts" not in reads.columns:
        return dealt
    split = kmer_tokens(known.filter("parts > 1"), k)
    return dealt.unionByName(split.mapInArrow(tokens, PIECES_SCHEMA))


def _token_columns(chunk: PieceChunk, k: int) -> list[np.ndarray]:
    """``(kmer, read_id, link)`` of the k-mers of :func:`_dealt_tokens`."""
    of, place = chunk.of, chunk.place
    prev = np.where(place > 0, chunk.bases(-1, 1), chunk.ends[of] >> 3)
    after = np.where(place < chunk.size[of] - 1, chunk.bases(k, 1), chunk.ends[of] & 7)
    link = (chunk.wide[1][of] + place) << 6 | prev << 3 | after
    return [chunk.bases(0, k), chunk.wide[0][of], link]


def linked_index(reads: DataFrame, k: int, hot_limit: int = 4096) -> DataFrame:
    """``(entry, cut, kmers, reads, links)``: the k-mers at which a run shared by two reads begins or ends.

    An entry holds whole k-mers, their reads sorted by the bases before and after. A k-mer in
    more than ``hot_limit`` reads is cut into blocks of up to ``BLOCK_ROWS``, and has an entry per
    pair of blocks: the first ``cut`` rows meet the others (0: one block, all meet all).
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in piece_chunks(batches, k, wide=2, ends=True):
            yield from _entries(chunk.number << _ENTRY_BITS, _token_columns(chunk, k), hot_limit)

    lists = _dealt_tokens(reads, k).repartition("bucket").sortWithinPartitions("bucket")
    return lists.mapInArrow(gather, _INDEX)


def _partners(key: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, end)``: which later rows each row meets, of rows sorted by k-mer and bases around it."""
    around, n = link & 63, len(key)
    new_key = np.append(True, key[1:] != key[:-1])[:n]
    new_class = new_key | np.append(True, around[1:] != around[:-1])[:n]
    key_at, class_at = np.flatnonzero(new_key), np.flatnonzero(new_class)
    end = np.append(key_at, n)[np.cumsum(new_key)]
    after = np.append(class_at, n)[np.cumsum(new_class)]
    alone = (around >> 3 == UNLINKED) | (around & 7 == UNLINKED)
    return np.where(alone, np.arange(n) + 1, after), end


def _entry_batch(entry: list[int], cut: list[int], ends: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int64())) for c in columns]
    return pa.record_batch(
        [pa.array(entry, pa.int64()), pa.array(cut, pa.int32()), *lists], names=["entry", "cut", "kmers", "reads", "links"]
    )


def _entries(base: int, columns: list[np.ndarray], hot_limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`linked_index` of a chunk of ``(kmer, read_id, link)``, whole k-mers."""
    order = np.argsort(columns[0])
    key = columns[0][order]
    equal = key[1:] == key[:-1]
    several = np.append(equal, False) | np.append(False, equal)
    key, read, link = (c[order[several]] for c in columns)
    if not len(key):
        return
    order = np.lexsort((link & 63, key))
    key, read, link = key[order], read[order], link[order]
    first, end = _partners(key, link)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    pairs = np.add.reduceat(end - first, start)
    hot = (size > hot_limit) & (pairs > 0)
    cold = (pairs > 0) & ~hot

    rows = np.repeat(cold, size)
    if rows.any():
        entry = np.cumsum(pairs[cold]) // ENTRY_PAIRS
        at = np.cumsum(size[cold]) - size[cold]
        begin = at[np.append(True, entry[1:] != entry[:-1])]
        numbers = base + np.arange(len(begin))
        yield _entry_batch(numbers, [0] * len(begin), np.append(begin, rows.sum()), [c[rows] for c in (key, read, link)])
        base += len(begin)
    for low, n in zip(start[hot].tolist(), size[hot].tolist(), strict=True):
        blocks = [slice(low + at, low + min(at + BLOCK_ROWS, n)) for at in range(0, n, BLOCK_ROWS)]
        for p, one in enumerate(blocks):
            for two in blocks[p:]:
                if link[one.start] & 63 == link[two.stop - 1] & 63 and first[one.start] != one.start + 1:
                    continue  # the same bases on both sides
                both = [c[one] if one == two else np.append(c[one], c[two]) for c in (key, read, link)]
                cut = 0 if one == two else one.stop - one.start
                yield _entry_batch([base], [cut], np.array([0, len(both[0])]), both)
                base += 1


def run_ends(
    key: np.ndarray, read: np.ndarray, link: np.ndarray, cut: int, repeated: bool = False
) -> Iterator[list[np.ndarray]]:
    """``(src, dst, delta)`` of an entry of the index, about ``ENTRY_PAIRS`` at a time."""
    if cut:
        first, end = np.full(cut, cut), np.full(cut, len(key))
    else:
        first, end = _partners(key, link)
    count = end - first
    done = np.cumsum(count)
    at = 0
    while at < len(count):
        before = done[at - 1] if at else 0
        last = max(int(np.searchsorted(done, before + ENTRY_PAIRS, side="right")), at + 1)
        n = count[at:last]
        i = np.repeat(np.arange(at, last), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:last], n)
        at = last
        differ = link[i] ^ link[j]
        around = link[i] & 63
        starts = (differ >> 3 & 7 != 0) | (around >> 3 == UNLINKED)
        ends = (differ & 7 != 0) | (around & 7 == UNLINKED)
        a, b = read[i], read[j]
        # both ranks grow by one along a run, so the smaller one is of the same read at both ends
        rank = np.minimum(link[i], link[j]) >> 6
        delta = np.where(ends, rank + 1, 0) - np.where(starts, rank, 0)
        kept = (starts | ends) & (repeated | (a != b))
        yield [np.minimum(a, b)[kept], np.maximum(a, b)[kept], delta[kept]]


def _pair_key(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return src.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + dst.astype(np.uint64)


def linked_pairs(index: DataFrame, m: int, repeated: bool = False) -> DataFrame:
    """``(src, dst, weight)`` with ``src < dst``: pairs that share at least ``m`` k-mers of a :func:`linked_index`.

    With ``repeated`` the rows of a read id that occurs several times are pairs of that id with itself.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cuts = batch.column(1).to_pylist()
            at = np.asarray(batch.column(2).offsets).tolist()
            values = [c.values.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            for cut, low, high in zip(cuts, at, at[1:], strict=False):
                for found in run_ends(*(v[low:high] for v in values), cut, repeated):
                    held.append(found)
                    if sum(len(h[0]) for h in held) >= ENTRY_PAIRS:
                        yield _dealt_pairs(held)
                        held = []
        if held:
            yield _dealt_pairs(held)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (src, dst, delta) in bucket_chunks(batches):
            yield _add_pairs(src, dst, delta, m)

    # entries are small and their pairs many, so their number of tasks must not follow their bytes
    spark = index.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ends = index.repartition(tasks, "entry").mapInArrow(deal, BUCKET_SCHEMA)
    together = ends.repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(add_up, "src bigint, dst bigint, weight bigint")


def _add_pairs(src: np.ndarray, dst: np.ndarray, delta: np.ndarray, m: int) -> pa.RecordBatch:
    """``(src, dst, weight)`` of all ends of some pairs, in order; pairs of at least ``m``."""
    at, weight = _summed(src, dst, delta)
    kept = weight >= m
    at, weight = at[kept], weight[kept]
    sort = np.lexsort((dst[at], src[at]))
    at = at[sort]
    return pa.record_batch([pa.array(c) for c in (src[at], dst[at], weight[sort])], names=["src", "dst", "weight"])


def _summed(src: np.ndarray, dst: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different pair, and the sum of its deltas."""
    # one number per pair is sorted quicker than two; where two pairs share it, both are sorted
    key = _pair_key(src, dst)
    order = np.argsort(key)
    new_key = np.append(True, key[order][1:] != key[order][:-1])
    new_pair = _changes(src[order], dst[order])
    if (new_key != new_pair).any():
        order = np.lexsort((dst, src))
        new_pair = _changes(src[order], dst[order])
    start = np.flatnonzero(new_pair)
    return order[start], np.add.reduceat(delta[order], start)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def _dealt_pairs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The ends of one pair go as their sum, if any is left."""
    src, dst, delta = (np.concatenate(c) for c in zip(*held))
    if len(src):
        at, delta = _summed(src, dst, delta)
        at, delta = at[delta != 0], delta[delta != 0]
        # neighbours in order have equal bytes
        order = np.argsort(src[at])
        src, dst, delta = src[at[order]], dst[at[order]], delta[order]
    return deal_to_buckets([src, dst, delta], by=_pair_key(src, dst))
