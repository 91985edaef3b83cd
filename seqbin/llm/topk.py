"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers, ``floor(256 x)``. A block of vectors keeps,
per attribute, its offset values as bit slices: one bitmap over the rows for every
bit. A query adds the slices of all attributes, weighted by the bits of its own
components, with full adders on whole bitmaps (carry-save, three bitmaps to two),
which leaves the slices of the sums. The best rows are selected from the most
significant slice downward; rows that tie at the boundary are resolved exactly by
integer product and smaller vec_id.

The slices of a block are built once and written as an index table. Blocks of queries are
repeated for every block of vectors and join the index on its number, so vectors cross the
network once and queries once per block; the scores of selected rows are read off the
slices of their sums. Each pair of blocks yields at most k rows per query, and a window
keeps the best k over all.

Vectors with components beyond ``NARROW`` (after scaling) do not fit 64-bit sums. They are
indexed as numbers and their products, as query or candidate, are exact: in limbs of 23
bits up to 2^46, in Python integers beyond. A score beyond 64 bits is shown as the largest
or smallest long; its rank is exact.

Defined cases: vectors without components have score 0 with each other; vectors of
different length never meet; null, and vectors with a null or non-finite component, take no
part; rows that repeat a vec_id are one candidate each but one query; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqbin.staging import stage

SCALE = 256
#: vectors of one block: the bitmaps of one slice take BLOCK_ROWS / 8 bytes
BLOCK_ROWS = 16_384
QUERY_ROWS = 128
#: scaled components below this, in at most MAX_DIMS dimensions, have exact 64-bit sums
NARROW = 1 << 24
MAX_DIMS = 1 << 14
_LIMB = 23
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def quantise(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dims, v array<int>, e array<double>)`` of usable ``(vec_id, embedding)`` rows.

    ``v`` is ``floor(256 x)``, or null where that is too large for it; then ``e`` holds x.
    Left out are rows whose id or embedding is null, or whose embedding holds a null or a
    non-finite component.
    """
    e = F.col("embedding").cast("array<double>")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = F.forall(e, lambda x: F.abs(x) * SCALE < float(NARROW)) & (F.size(e) <= MAX_DIMS)
    whole = F.transform(e, lambda x: F.floor(x * SCALE).cast("int"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size(e).cast("long").alias("dims"),
        F.when(narrow, whole).alias("v"),
        F.when(~narrow, e).alias("e"),
    )


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(low, slices)``: per attribute the smallest value, and bitmaps of the rest.

    ``values (rows, dims)``; ``slices (bits, dims, words)`` of 64 rows a word.
    """
    rows, dims = values.shape
    low = values.min(axis=0)
    offset = (values - low).T
    bits = max(1, int(offset.max()).bit_length())
    width = -(-rows // 64) * 64
    slices = np.zeros((bits, dims, width // 8), np.uint8)
    for b in range(bits):
        slices[b, :, : -(-rows // 8)] = np.packbits((offset >> b & 1).astype(bool), axis=1, bitorder="little")
    return low, slices.view(np.uint64)


def add_slices(slices: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of ``sum |w_d| * u_d`` and the constant that completes it to ``sum w_d * v'_d``.

    ``u_d`` is the offset value, or its complement where the weight is negative; so
    nothing is ever subtracted.
    """
    bits, dims, words = slices.shape
    size = np.abs(weights)
    top = (1 << bits) - 1
    constant = -int(size[weights < 0].sum()) * top
    flip = (weights < 0)[None, :, None]
    used = np.where(flip, ~slices, slices)
    columns: dict[int, list[np.ndarray]] = {}
    for j in range(int(size.max()).bit_length()):
        chosen = np.flatnonzero(size >> j & 1)
        for b in range(bits):
            if len(chosen):
                columns.setdefault(b + j, []).append(used[b, chosen])
    out, place = [], 0
    while place <= max(columns, default=-1):
        stack = columns.pop(place, [])
        pile = np.concatenate(stack) if stack else np.zeros((1, words), np.uint64)
        while len(pile) > 1:
            third = len(pile) // 3
            if third:
                a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                pile = np.concatenate([half ^ c, pile[3 * third :]])
            else:
                a, b = pile[:1], pile[1:2]
                carry = a & b
                pile = a ^ b
            columns.setdefault(place + 1, []).append(carry)
        out.append(pile[0])
        place += 1
    return out, constant


def best_rows(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sure, tied)`` bitmaps: rows surely among the best k, and the ties for the rest."""
    sure, tied = np.zeros_like(allowed), allowed
    for part in reversed(sums):
        high = tied & part
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(high).sum())
        if n > k:
            tied = high
        else:
            sure = sure | high
            tied = tied & ~part
            if n == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def slice_values(low: np.ndarray, slices: np.ndarray, rows: int) -> np.ndarray:
    """The integers ``(rows, dims)`` of an index block."""
    values = np.repeat(low[:, None], rows, 1)
    for b, of_bit in enumerate(slices):
        bits = np.unpackbits(of_bit.view(np.uint8).reshape(len(low), -1), axis=1, bitorder="little")[:, :rows]
        values += bits.astype(np.int64) << b
    return values.T


def _best_sliced(allowed_rows: np.ndarray, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, weights: np.ndarray, k: int):
    """``(rows, scores)`` of the best k allowed rows, by the slices of their sums."""
    width = slices.shape[2] * 64
    mask = np.zeros(width, bool)
    mask[: len(ids)] = allowed_rows
    sums, constant = add_slices(slices, weights)
    sure, tied = best_rows(sums, np.packbits(mask, bitorder="little").view(np.uint64), k)
    first, rest = _rows_of(sure), _rows_of(tied)
    if len(first) < k and len(rest):
        keep = np.lexsort((rest, ids[rest]))[: k - len(first)]
        first = np.concatenate([first, rest[keep]])
    # sums wrap around like the score, which fits 64 bits
    score = np.zeros(len(first), np.uint64)
    for place, part in enumerate(sums[:64]):
        score += (part[first >> 6] >> (first & 63).astype(np.uint64) & np.uint64(1)) << np.uint64(place)
    return first, (score + np.uint64((constant + int(weights @ low)) % (1 << 64))).view(np.int64)


def exact_products(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of integer rows of any size, as Python integers."""
    top = max((int(abs(edge)) for x in (values, weights) if x.size for edge in (x.min(), x.max())), default=0)
    if top >> 2 * _LIMB or len(weights) > MAX_DIMS:
        return values.astype(object) @ weights.astype(object) if len(weights) else np.zeros(len(values), object)
    values, weights = values.astype(np.int64), weights.astype(np.int64)
    high, wide = values >> _LIMB, weights >> _LIMB
    rest, small = values - (high << _LIMB), weights - (wide << _LIMB)
    parts = (high @ wide, high @ small + rest @ wide, rest @ small)
    return sum(p.astype(object) << _LIMB * (2 - i) for i, p in enumerate(parts))


def _best_exact(allowed_rows: np.ndarray, ids: np.ndarray, values: np.ndarray, weights: np.ndarray, k: int):
    rows = np.flatnonzero(allowed_rows)
    score = exact_products(values[rows], weights)
    best = heapq.nsmallest(k, range(len(rows)), key=lambda i: (-score[i], ids[rows[i]], i))
    return rows[best], score[best]


def _beyond(score: int) -> str:
    """Orders scores beyond 64 bits, which all show as the same number."""
    if _LOWEST <= score <= _HIGHEST:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99_999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)


def _whole(row: bytes, dims: int) -> np.ndarray:
    """Scaled integers of vectors kept as doubles."""
    x = np.frombuffer(row, np.float64)
    out = np.empty(len(x), object)
    # 256 x is exact for doubles, but may pass their range
    out[:] = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.tolist()]
    return out.reshape(-1, dims)


def _grouped(rows: DataFrame, key: str, count: int, run) -> DataFrame:
    """Rows dealt to blocks in turn, whatever their values; one call per block, length and kind."""
    dealt = rows.withColumn(key, F.monotonically_increasing_id() % count).withColumn("wide", F.col("v").isNull())
    return dealt.groupBy(key, "dims", "wide").applyInArrow(
        run, f"{key} long, dims long, wide boolean, ids binary, low binary, bits long, body binary"
    )


def _row(table: pa.Table, key: str, ids: np.ndarray, low: bytes, bits: int, body: bytes) -> pa.Table:
    first = [table.column(c)[0].as_py() for c in (key, "dims", "wide")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    values = [*first, ids.tobytes(), low, bits, body]
    names = [key, "dims", "wide", "ids", "low", "bits", "body"]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=names)


def _flat(table: pa.Table, column: str, dtype) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)


def build_index(vectors: DataFrame, count: int) -> DataFrame:
    """The bit-sliced index: per block its ids, lowest values and slices (numbers, if wide)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        if table.column("wide")[0].as_py():
            return _row(table, "block", ids, b"", 0, _flat(table, "e", np.float64).tobytes())
        values = _flat(table, "v", np.int64).reshape(len(ids), -1)
        if not values.shape[1]:
            return _row(table, "block", ids, b"", 0, b"")
        low, slices = build_slices(values)
        return _row(table, "block", ids, low.tobytes(), len(slices), slices.tobytes())

    return _grouped(vectors, "block", count, run)


def _pack_queries(queries: DataFrame, count: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        wide = table.column("wide")[0].as_py()
        body = _flat(table, "e", np.float64) if wide else _flat(table, "v", np.int32)
        return _row(table, "qblock", table.column("vec_id").to_numpy(), b"", 0, body.tobytes())

    return _grouped(queries, "qblock", count, run)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of an index block for each query of a block of queries."""
    for batch in batches:
        for at in range(batch.num_rows):
            dims, wide, ids, low, bits, body, asking_wide, query_ids, asked = (
                batch.column(c)[at].as_py() for c in range(batch.num_columns)
            )
            ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
            if asking_wide:
                queries = _whole(asked, dims)
            else:
                queries = np.frombuffer(asked, np.int32).astype(np.int64).reshape(len(query_ids), dims)
            sliced = bool(dims) and not wide and not asking_wide
            if dims and not wide:
                low = np.frombuffer(low, np.int64)
                slices = np.frombuffer(body, np.uint64).reshape(bits, dims, -1)
            if not sliced:
                values = np.zeros((len(ids), 0), np.int64) if not dims else _whole(body, dims) if wide else slice_values(low, slices, len(ids))
            found = []
            for q, weights in zip(query_ids.tolist(), queries, strict=True):
                others = ids != q
                if sliced:
                    rows, score = _best_sliced(others, ids, low, slices, weights, k)
                else:
                    rows, score = _best_exact(others, ids, values, weights, k)
                for v, s in zip(ids[rows].tolist(), score.tolist()):
                    found.append((q, v, min(max(s, _LOWEST), _HIGHEST), _beyond(s)))
            columns = list(zip(*found)) or [[]] * 4
            yield pa.record_batch(
                [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["query_id", "vec_id", "score", "beyond"],
            )


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    with another vec_id; ties go to the smaller vec_id. With fewer than k candidates all
    are returned.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    used = stage(quantise(vectors.select("vec_id", "embedding")), "quantised")
    asked = stage(
        used.filter(F.pmod("vec_id", F.lit(every)) == 0)
        .groupBy("vec_id")
        .agg(F.min(F.struct("dims", "v", "e")).alias("s"))
        .select("vec_id", "s.*"),
        "queries",
    )
    blocks = max(2, -(-used.count() // BLOCK_ROWS))
    qblocks = max(1, -(-asked.count() // QUERY_ROWS))
    index = stage(build_index(used, blocks), "sliced-index")
    queries = _pack_queries(asked, qblocks).select(
        "dims", F.col("wide").alias("asking_wide"), F.col("ids").alias("query_ids"), F.col("body").alias("asked")
    )
    # every block of queries meets every block of vectors, by its number
    repeated = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = index.join(repeated, ["block", "dims"])
    best = met.select("dims", "wide", "ids", "low", "bits", "body", "asking_wide", "query_ids", "asked").mapInArrow(
        lambda batches: _search(batches, k), "query_id long, vec_id long, score long, beyond string"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
with q as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
           from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
pairs as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(
            cast(a.v as double[]), cast(b.v as double[])) as bigint) as score
          from q a join q b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
           from pairs)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5"""
