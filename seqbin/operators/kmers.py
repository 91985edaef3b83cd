"""k-mers of reads, the inverted index, and canonical k-mer counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.functions.dna import MAX_PACKED_K, kmers_of, revcomp
from seqbin.functions.vocabulary import canonical_kmers, canonical_size, word_table
from seqbin.memory import give_back
from seqbin.operators.indexing import list_parts, with_group_position
from seqbin.operators.pieces import (
    PIECES_SCHEMA,
    binaries,
    deal_pieces,
    from_planes,
    joined_bases,
    piece_chunks,
    slices,
    to_planes,
)
from seqbin.operators.skew import sample_reads, sample_step
from seqbin.staging import stage

#: neighbour code of a token that is not linked on that side
UNLINKED = 4
#: bases handled at a time inside one Arrow batch
_CHUNK_BASES = 2_000_000
#: largest k whose counts are kept as one array per key: 512 numbers
MAX_HISTOGRAM_K = 5
#: rows, and keys, whose histograms are held at a time inside one task
_HISTOGRAM_ROWS = 2048
#: k-mers are dealt to two to this power buckets by hash
_BUCKET_BITS = 14
#: bits of a hash by which rows that may be equal are marked
_MARK_BITS = 22
#: rows of whole buckets that are worked on at a time
_BUCKET_ROWS = 1_000_000
#: two-bit code of a base letter, 4 for any other byte
_BASE_CODE = np.full(256, 4, np.uint8)
_BASE_CODE[list(b"ACGT")] = range(4)


def read_kmers(reads: DataFrame, k: int, carry: str | None = None) -> DataFrame:
    """``(read_id, kmer)``: the set of k-mers of each read, over all its mates.

    Duplicates are removed inside the row, before the rows are multiplied.
    Only reads held in several rows need a distinct across rows. ``carry`` names
    a bigint column of ``reads`` to keep beside each k-mer.
    """
    columns = ["read_id", F.explode(distinct_kmers("mates", k)).alias("kmer"), *_carried(carry)]
    if "parts" not in reads.columns:
        return reads.select(*columns)
    one = reads.filter("parts = 1").select(*columns)
    return one.unionByName(reads.filter("parts > 1").select(*columns).distinct())


def distinct_kmers(mates: Column | str, k: int) -> Column:
    """The different k-mers of the runs of all mates, in reading order."""
    runs = F.flatten(F.col(mates) if isinstance(mates, str) else mates)
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: kmers_of(run, k))))


def read_kmer_lists(reads: DataFrame, k: int) -> DataFrame:
    """``(read_id, kmers)``: what :func:`read_kmers` has for a read, as one sorted list.

    The rows of a read meet before they are multiplied, so bases are shuffled and not
    k-mers. A read without any k-mer has no row.
    """
    parts = F.col("parts") if "parts" in reads.columns else F.lit(1)
    rows = reads.groupBy("read_id").agg(F.collect_list(F.struct(parts.alias("parts"), "mates")).alias("rows"))
    one, several = (F.filter("rows", test) for test in (lambda r: r["parts"] == 1, lambda r: r["parts"] > 1))
    # a read held in one row is a set by itself; the rows of a split read are one set
    whole = F.flatten(F.transform(one, lambda r: distinct_kmers(r["mates"], k)))
    split = distinct_kmers(F.flatten(F.transform(several, lambda r: r["mates"])), k)
    # told from the lengths, so that the filter does not list the k-mers a second time
    runs = F.flatten(F.flatten(F.transform("rows", lambda r: r["mates"])))
    some = rows.filter(F.exists(runs, lambda run: F.length(run) >= k))
    return some.select("read_id", F.sort_array(F.concat(whole, split)).alias("kmers"))


def kmer_keys(reads: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """``(read_id, key)``: the packed key of every k-mer, or of each different k-mer, of each row of ``reads``.

    The keys are those of :func:`seqbin.functions.dna.kmer_key`, packed for whole Arrow
    batches from the runs, so no k-mer is ever a text.
    """
    if not 1 <= k <= MAX_PACKED_K:
        raise ValueError(f"packed k-mers need 1 <= k <= {MAX_PACKED_K}")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            _, _, run_of, key = chunk_keys(chars, run_at, k)
            read = row[run_of]
            if distinct:
                kept = first_places(read, key)
                read, key = read[kept], key[kept]
            yield pa.record_batch([batch.column(0).take(pa.array(read)), pa.array(key)], names=["read_id", "key"])

    runs = F.filter(F.flatten("mates"), lambda run: F.length(run) >= k).alias("runs")
    kept = reads.select("read_id", runs).filter(F.size("runs") > 0)
    return kept.mapInArrow(packed, "read_id bigint, key bigint")


def _carried(carry: str | None) -> list[Column]:
    return [] if carry is None else [F.col(carry).cast("bigint").alias(carry)]


def kmer_tokens(reads: DataFrame, k: int, carry: str | None = None) -> DataFrame:
    """``(read_id, kmer, link)``: :func:`read_kmers` with packed keys and run links.

    ``kmer`` is the two-bit bigint code, so k is at most 31. ``link`` holds the
    rank of the k-mer among the distinct k-mers of its read and the bases just
    before and after it, where that neighbour is the previous or next distinct
    k-mer (see :func:`link_rank`). The packing is numpy over whole Arrow batches.
    """
    if not 1 <= k <= MAX_PACKED_K:
        raise ValueError(f"packed k-mers need 1 <= k <= {MAX_PACKED_K}")
    runs = F.filter(F.flatten("mates"), lambda run: F.length(run) >= k).alias("runs")
    schema = "read_id bigint, kmer bigint, link bigint"
    if carry is not None:
        schema += f", {carry} bigint"

    def packed(rows: DataFrame) -> DataFrame:
        kept = rows.select("read_id", runs, *_carried(carry)).filter(F.size("runs") > 0)
        return kept.mapInArrow(lambda batches: _pack_batches(batches, k, carry), schema)

    if "parts" not in reads.columns:
        return packed(reads)
    # the rank of a k-mer is not known across the rows of a split read
    unlinked = F.lit(UNLINKED * 9).cast("bigint")
    several = packed(reads.filter("parts > 1")).withColumn("link", unlinked).distinct()
    return packed(reads.filter("parts = 1")).unionByName(several)


def link_rank(link: Column) -> Column:
    """Rank of the k-mer in its read."""
    return F.shiftright(link, 6)


def link_prev(link: Column) -> Column:
    """Base before the k-mer (0-3), or ``UNLINKED``."""
    return F.shiftright(link, 3).bitwiseAND(F.lit(7))


def link_next(link: Column) -> Column:
    """Base after the k-mer (0-3), or ``UNLINKED``."""
    return link.bitwiseAND(F.lit(7))


def run_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(batch, chars, run_at, row)`` of ``(read_id, runs)`` batches, whole rows of about ``_CHUNK_BASES``.

    Run i is ``chars[run_at[i]:run_at[i + 1]]`` and belongs to row ``row[i]`` of the batch.
    """
    for batch in batches:
        runs = batch.column(1)
        row_at = np.asarray(runs.offsets)
        text = runs.values
        chars = np.frombuffer(text.buffers()[2], dtype=np.uint8)
        width = np.int64 if pa.types.is_large_string(text.type) else np.int32
        char_at = np.frombuffer(text.buffers()[1], dtype=width)[text.offset : text.offset + len(text) + 1]
        row_chars = char_at[row_at].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            # whole rows up to the chunk size, at least one
            last = int(np.searchsorted(row_chars, row_chars[first] + _CHUNK_BASES, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            spans = char_at[row_at[first] : row_at[last] + 1].astype(np.int64)
            row = np.repeat(np.arange(first, last), np.diff(row_at[first : last + 1]))
            yield batch, chars[spans[0] : spans[-1]], spans - spans[0], row
            first = last
        give_back()


def _pack_batches(
    batches: Iterator[pa.RecordBatch], k: int, carry: str | None
) -> Iterator[pa.RecordBatch]:
    for batch, chars, run_at, row in run_chunks(batches):
        row, key, link = _pack_chunk(chars, run_at, row, k)
        columns = {"read_id": batch.column(0).to_numpy(zero_copy_only=False)[row], "kmer": key, "link": link}
        if carry is not None:
            columns[carry] = batch.column(2).to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in columns.items()})


def first_places(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows, ascending.

    A row whose 64 bits of hash occur once is different from all others; only the rest, and
    what agrees with it in the first bits, is compared by value.
    """
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.arange(len(mixed))
    near = np.zeros(1 << _MARK_BITS, bool)
    near[twice >> np.uint64(64 - _MARK_BITS)] = True
    some = np.flatnonzero(near[mixed >> np.uint64(64 - _MARK_BITS)])
    order = some[np.lexsort([column[some] for column in reversed(columns)])]
    later = np.logical_and.reduce([column[order][1:] == column[order][:-1] for column in columns])
    kept = np.ones(len(mixed), bool)
    kept[order[1:][later]] = False
    return np.flatnonzero(kept)


def chunk_keys(chars: np.ndarray, run_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-bit codes of all bases, and place, run and packed key of every k-mer."""
    base = (_BASE_CODE[chars] & 3).astype(np.int64)
    keys = joined_bases(base, k)
    per_run = np.diff(run_at) - k + 1
    total = int(per_run.sum())
    run_of = np.repeat(np.arange(len(per_run)), per_run)
    at = np.arange(total) + np.repeat(run_at[:-1] - (np.cumsum(per_run) - per_run), per_run)
    return base, at, run_of, keys[at]


def _pack_chunk(
    chars: np.ndarray, run_at: np.ndarray, run_read: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Read, key and link of every distinct k-mer; run i is chars[run_at[i]:run_at[i + 1]]."""
    return pack_places(chars, run_at, run_read, k)[3:]


def pack_places(chars: np.ndarray, run_at: np.ndarray, run_read: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Codes of all bases, and place, run, read, key and link of every distinct k-mer, in reading order."""
    base, at, run_of, key = chunk_keys(chars, run_at, k)
    read = run_read[run_of]

    # keep the first place of each k-mer in its read, in reading order
    kept = first_places(read, key)
    if len(kept) < len(at):
        at, run_of, key, read = at[kept], run_of[kept], key[kept], read[kept]

    new_read = np.ones(len(kept), bool)
    new_read[1:] = read[1:] != read[:-1]
    starts = np.flatnonzero(new_read)
    rank = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
    joined = np.zeros(len(kept) + 1, bool)  # joined[i]: token i directly follows token i-1
    joined[1:-1] = (run_of[1:] == run_of[:-1]) & (at[1:] == at[:-1] + 1)
    prev = np.where(joined[:-1], base[at - 1], UNLINKED)
    after = np.where(joined[1:], base[np.minimum(at + k, len(base) - 1)], UNLINKED)
    return base, at, run_of, read, key, (rank << 6) | (prev << 3) | after


def deal_to_buckets(columns: list[np.ndarray], by: np.ndarray | None = None) -> pa.RecordBatch:
    """``(bucket, n, lists)``: one row per bucket, with the values of all columns in byte planes.

    The first column, or ``by``, gives the bucket by its hash: that of the packed k-mer, for one.
    So lists are shuffled and not a row per k-mer.
    """
    mixed = (columns[0] if by is None else by).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(64 - _BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    rows = np.diff(np.append(starts, len(bucket)))
    table = np.stack([c[order].astype("<i8") for c in columns], axis=1).view(np.uint8)
    arrays = [
        pa.array(bucket[starts].astype(np.int32)),
        pa.array(rows.astype(np.int32)),
        binaries(to_planes(table, starts, rows), rows * table.shape[1]),
    ]
    return pa.record_batch(arrays, names=["bucket", "n", "lists"])


BUCKET_SCHEMA = "bucket int, n int, lists binary"


def bucket_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first bucket, columns)`` of whole buckets, from :func:`deal_to_buckets` rows sorted by bucket.

    All rows of a k-mer are in one chunk.
    """
    held: list[tuple[np.ndarray, int]] = []
    size, first, last = 0, 0, None

    def listed() -> list[np.ndarray]:
        data, rows = np.concatenate([lists for lists, _ in held]), np.array([n for _, n in held])
        table = from_planes(data, rows, len(data) // size)
        return list(np.ascontiguousarray(table.view("<i8").T))

    for batch in batches:
        for bucket, n, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), slices(batch.column(2))):
            if bucket != last:
                if size >= _BUCKET_ROWS:
                    yield first, listed()
                    held, size = [], 0
                last = bucket
                first = first if held else last
            held.append((lists, n))
            size += n
    if held:
        yield first, listed()


def kmer_index(read_kmers: DataFrame, min_reads: int = 2, max_list: int = 4096) -> DataFrame:
    """``(kmer, part, parts, adjacency)``: sorted read ids of each shared k-mer.

    A k-mer in more than ``max_list`` reads is held in ``parts`` rows, each with the next
    ``max_list`` ids, so a hot k-mer is never gathered into one array nor in one join key;
    ``parts`` is 1 for all others.
    """
    placed = with_group_position(read_kmers.select("kmer", "read_id"), ["kmer"], ["read_id"], "first", "at", "n")
    return (
        placed.filter(F.col("n") >= min_reads)
        .groupBy("kmer", *list_parts("at", "n", max_list))
        .agg(F.sort_array(F.collect_list("read_id")).alias("adjacency"))
    )


#: a k-mer in more reads than this is not gathered in one bucket
BUCKET_READS = 1 << 20
#: stands for a null read id inside buckets; it sorts first, as null does
_NO_READ = np.iinfo(np.int64).min


def kmer_index_of_reads(reads: DataFrame, k: int, min_reads: int = 2, max_list: int = 4096) -> DataFrame:
    """:func:`kmer_index` of the k-mers of ``reads``.

    k-mers that can be packed are shuffled once, as pieces of runs, and are text again only
    in the rows of the index. A sample of reads finds those in more than about ``BUCKET_READS``
    reads, which are placed by range instead.
    """
    if k > MAX_PACKED_K or "parts" in reads.columns:
        return kmer_index(read_kmers(reads, k), min_reads, max_list)
    step = sample_step(BUCKET_READS)
    sampled = _hot_packed(sample_reads(reads, step), k, BUCKET_READS, step)
    # at most as many as the k-mers of all reads divided by the limit
    hot = np.array(sorted(r["key"] for r in sampled.select("key").collect()), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chars, run_at, row in run_chunks(batches):
            base, at, run_of, key = distinct_places(chars, run_at, row, k)
            if len(hot):
                cold = ~np.isin(key, hot)
                at, run_of = at[cold], run_of[cold]
            ids = pc.fill_null(batch.column(0), _NO_READ).to_numpy(zero_copy_only=False)
            yield deal_pieces(base, at, run_of, k, [ids[row[run_of]]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in piece_chunks(batches, k, wide=1):
            yield _index_lists(chunk.bases(0, k), chunk.wide[0][chunk.of], k, min_reads, max_list)

    runs = F.filter(F.flatten("mates"), lambda run: F.length(run) >= k).alias("runs")
    kept = reads.select("read_id", runs).filter(F.size("runs") > 0)
    dealt = kept.mapInArrow(deal, PIECES_SCHEMA).repartition("bucket").sortWithinPartitions("bucket")
    index = dealt.mapInArrow(gather, "kmer string, part int, parts int, adjacency array<bigint>")
    if not len(hot):
        return index
    rows = kmer_keys(reads, k, distinct=True).withColumnRenamed("key", "kmer")
    rows = rows.join(F.broadcast(sampled.select(F.col("key").alias("kmer"))), "kmer", "left_semi")
    codes = (F.shiftright("kmer", 2 * place).bitwiseAND(F.lit(3)) for place in reversed(range(k)))
    letters = F.concat(*(F.get(F.array(*map(F.lit, "ACGT")), code.cast("int")) for code in codes))
    return index.unionByName(kmer_index(rows, min_reads, max_list).withColumn("kmer", letters))


def distinct_places(chars: np.ndarray, run_at: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Codes of all bases, and place, run and key of every distinct k-mer of a row."""
    base, at, run_of, key = chunk_keys(chars, run_at, k)
    kept = first_places(row[run_of], key)
    return base, at[kept], run_of[kept], key[kept]


def _hot_packed(reads: DataFrame, k: int, limit: int, step: int) -> DataFrame:
    """:func:`seqbin.operators.skew.hot_keys` of the distinct :func:`kmer_keys`, from pieces of runs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chars, run_at, row in run_chunks(batches):
            base, at, run_of, _ = distinct_places(chars, run_at, row, k)
            yield deal_pieces(base, at, run_of, k, [])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in piece_chunks(batches, k, wide=0):
            key, n = np.unique(chunk.bases(0, k), return_counts=True)
            kept = n * step > limit
            yield pa.record_batch([pa.array(key[kept]), pa.array(n[kept] * step)], names=["key", "n_est"])

    runs = F.filter(F.flatten("mates"), lambda run: F.length(run) >= k).alias("runs")
    kept = reads.select("read_id", runs).filter(F.size("runs") > 0)
    dealt = kept.mapInArrow(deal, PIECES_SCHEMA).repartition("bucket").sortWithinPartitions("bucket")
    return stage(dealt.mapInArrow(gather, "key bigint, n_est bigint"), "hot-packed")


def _index_lists(key: np.ndarray, read: np.ndarray, k: int, min_reads: int, max_list: int) -> pa.RecordBatch:
    """Rows of :func:`kmer_index` of whole k-mers."""
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    # numbers of k-mer and read in one are sorted quicker than both
    ids, rank = np.unique(read, return_inverse=True)
    both = np.sort((np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32) | rank[order].astype(np.uint64))
    read = ids[(both & np.uint64((1 << 32) - 1)).astype(np.int64)]
    kept = np.repeat(size >= min_reads, size)
    key, read, size = key[kept], read[kept], size[size >= min_reads]
    start = np.cumsum(size) - size
    at = np.arange(len(key)) - np.repeat(start, size)
    first = np.flatnonzero(at % max_list == 0)
    known = np.append(0, np.cumsum(read != _NO_READ))
    offsets = known[np.append(first, len(key))]
    text, code = np.empty((k, len(first)), np.uint8), key[first]
    for place in range(k):
        text[place] = (code >> 2 * (k - 1 - place)).astype(np.uint8) & 3
    text = np.ascontiguousarray(np.frombuffer(b"ACGT", np.uint8)[text].T)
    ends = pa.py_buffer(np.arange(len(first) + 1, dtype=np.int32) * k)
    parts = np.repeat(-(-size // max_list), size)[first]
    columns = [
        pa.StringArray.from_buffers(len(first), ends, pa.py_buffer(text)),
        pa.array((at[first] // max_list).astype(np.int32)),
        pa.array(parts.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(read[read != _NO_READ], pa.int64())),
    ]
    return pa.record_batch(columns, names=["kmer", "part", "parts", "adjacency"])


def kmer_profile(keyed_runs: DataFrame, k: int = 4) -> DataFrame:
    """``(key, kmer, weight, forward)`` from ``(key, run)``, one row per representative.

    ``weight`` counts each k-mer and its reverse complement, so a palindrome
    counts twice; ``forward`` counts it once. Up to ``MAX_HISTOGRAM_K`` the rows come
    from :func:`kmer_histograms`, beyond it k-mers are counted as rows.
    """
    if k <= MAX_HISTOGRAM_K:
        entries = kmer_histograms(keyed_runs, k).select("key", F.posexplode("counts").alias("idx", "forward"))
        names = canonical_kmers(keyed_runs.sparkSession, k).withColumn("twice", F.col("kmer") == revcomp("kmer"))
        counted = entries.filter("forward > 0").join(F.broadcast(names), "idx")
    else:
        words = keyed_runs.select("key", F.explode(kmers_of("run", k)).alias("word"))
        table = F.broadcast(word_table(keyed_runs.sparkSession, k))
        counted = words.join(table, "word").groupBy("key", "kmer", "twice").agg(F.count("*").alias("forward"))
    weight = F.col("forward") * F.when(F.col("twice"), 2).otherwise(1)
    return counted.select("key", "kmer", weight.alias("weight"), "forward")


def kmer_histograms(keyed_runs: DataFrame, k: int = 4) -> DataFrame:
    """``(key, counts)`` from ``(key, run)``: how often each canonical k-mer occurs, by its number.

    Runs are counted where they are, so a key is shuffled as one row of
    ``canonical_size(k)`` numbers per task and not as one row per k-mer. Rows of a key are
    then added up as they stream by in key order; no key is held as a list. A key whose
    runs are null or shorter than k gets zeros.
    """
    if not 1 <= k <= MAX_HISTOGRAM_K:
        raise ValueError(f"histograms need 1 <= k <= {MAX_HISTOGRAM_K}")
    key = keyed_runs.schema["key"].dataType.simpleString()
    schema, size = f"key {key}, counts array<bigint>", canonical_size(k)
    counted = keyed_runs.select("key", "run").mapInArrow(lambda batches: _count_batches(batches, k, size), schema)
    placed = counted.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(lambda batches: _add_sorted(batches, size), schema)


def canonical_numbers(k: int) -> np.ndarray:
    """Number of the canonical k-mer of every packed k-mer (two bits a base, A C G T)."""
    code = np.arange(4**k)
    reverse = np.zeros_like(code)
    for place in range(k):
        reverse = reverse * 4 + 3 - (code >> (2 * place) & 3)
    return np.unique(np.minimum(code, reverse), return_inverse=True)[1]


def _histogram(keys: np.ndarray, runs: pa.Array, numbers: np.ndarray, k: int, size: int, n_keys: int) -> np.ndarray:
    """Counts by key number and canonical k-mer over the runs of a batch."""
    ends = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset : runs.offset + len(runs) + 1]
    run_of = np.repeat(np.arange(len(runs)), np.diff(ends))
    text = np.frombuffer(runs.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    base = _BASE_CODE[text]
    n = len(base) - k + 1
    if n < 1:
        return np.zeros((n_keys, size), np.int64)
    code, whole = np.zeros(n, np.int64), run_of[:n] == run_of[k - 1 :]
    for place in range(k):
        part = base[place : place + n]
        code = code * 4 + (part & 3)
        whole &= part < 4
    cell = keys[run_of[:n][whole]] * size + numbers[code[whole]]
    return np.bincount(cell, minlength=n_keys * size).reshape(n_keys, size)


def _count_batches(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    numbers = canonical_numbers(k)
    sums: dict[object, np.ndarray] = {}
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for start in range(0, batch.num_rows, _HISTOGRAM_ROWS):
            part = batch.slice(start, _HISTOGRAM_ROWS)
            named = part.column(0).dictionary_encode(null_encoding="encode")
            keys = named.dictionary.to_pylist()
            runs = pc.fill_null(part.column(1), "").cast(pa.large_string())
            counts = _histogram(named.indices.to_numpy(), runs, numbers, k, size, len(keys))
            for key, row in zip(keys, counts, strict=True):
                sums[key] = sums[key] + row if key in sums else row
            if len(sums) >= _HISTOGRAM_ROWS:
                yield _histogram_batch(list(sums), np.array(list(sums.values())), kind)
                sums = {}
    if sums:
        yield _histogram_batch(list(sums), np.array(list(sums.values())), kind)


def _histogram_batch(keys: list, counts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * counts.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel(), pa.int64()))
    return pa.record_batch([pa.array(keys, kind), lists], names=["key", "counts"])


def _add_sorted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Add up the rows of each key of a partition sorted by key; one key is open at a time."""
    key, total, kind = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(0).type
        named = batch.column(0).dictionary_encode(null_encoding="encode")
        index = named.indices.to_numpy()
        starts = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        rows = batch.column(1).flatten().to_numpy().reshape(-1, size)
        sums = np.add.reduceat(rows, starts, axis=0)
        keys = [named.dictionary[index[i]].as_py() for i in starts.tolist()]
        if total is not None:
            if keys[0] == key:
                sums[0] += total
            else:
                keys, sums = [key, *keys], np.vstack([total, sums])
        key, total = keys[-1], sums[-1].copy()
        if len(keys) > 1:
            yield _histogram_batch(keys[:-1], sums[:-1], kind)
    if total is not None:
        yield _histogram_batch([key], total[None], kind)
