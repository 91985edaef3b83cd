"""k-mers of reads, shuffled as pieces of their runs.

k-mers that follow each other in a run mostly have the same minimizer, the word of the
smallest hash inside them (minimum substring partitioning, Li et al. 2013). A piece is a
stretch of such k-mers: its bases go once, two bits each, to the bucket of the minimizer, so
n k-mers cost about ``n + k - 1`` bases and one row head and not n rows. All places of a
k-mer are in one bucket, whose k-mers are listed again where they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from seqbin.memory import give_back

PIECES_SCHEMA = "bucket int, kmers int, heads binary, size int, bases binary"
#: pieces are dealt to two to this power buckets by the hash of their minimizer
_BUCKET_BITS = 11
#: bases of a minimizer, at most
_MINIMIZER = 12
#: k-mers of one piece, at most
_PIECE_KMERS = 64
#: k-mers of whole buckets that are listed at a time, about; those of a bucket of over ``PART_ROWS`` come in parts by hash
CHUNK_ROWS = 400_000
PART_ROWS = 2 * CHUNK_ROWS
#: chunks are numbered inside the number of their first bucket
_PART_BITS = 16


def joined_bases(base: np.ndarray, k: int) -> np.ndarray:
    """Packed key of the ``k`` bases from every place on, put together from pieces of 1, 2, 4, ... bases."""
    n = len(base) - k + 1
    keys, piece, done, width = np.zeros(n, np.int64), base, 0, 1
    while True:
        if k & width:
            keys = (keys << 2 * width) | piece[done : done + n]
            done += width
        if 2 * width > k:
            return keys
        piece = (piece[:-width] << 2 * width) | piece[width:]
        width *= 2


def minimizers(base: np.ndarray, k: int) -> np.ndarray:
    """Smallest hash of the words inside the ``k`` bases from every place on."""
    width = min(_MINIMIZER, (k + 1) // 2)
    h = joined_bases(base, width).astype(np.uint32) + np.uint32(0x7F4A7C15)
    for factor in (0x9E3779B1, 0x85EBCA77):
        h *= np.uint32(factor)
        h ^= h >> np.uint32(15)
    words, done = k - width + 1, 1
    while done < words:
        step = min(done, words - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def deal_pieces(
    base: np.ndarray, at: np.ndarray, run_of: np.ndarray, k: int, wide: list[np.ndarray], ends: np.ndarray | None = None
) -> pa.RecordBatch:
    """``PIECES_SCHEMA``: the k-mers at the places ``at`` of ``base``, ascending, one row per bucket.

    A piece lies in one run and carries the value of its first k-mer from each of the columns
    ``wide``. ``ends`` are codes of the bases around each k-mer, the one before times eight plus
    the one after; the piece carries what is before its first and after its last k-mer.
    """
    h = minimizers(base, k)[at] if len(at) else np.zeros(0, np.uint32)
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (run_of[1:] != run_of[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % _PIECE_KMERS == 0)
    size = np.diff(np.append(first, len(at)))
    # a smallest hash is small: mixed again
    bucket = (h[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, first, size = bucket[order], first[order], size[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    rows = np.diff(np.append(start, len(bucket)))

    fields = [column[first].astype("<i8").view(np.uint8).reshape(-1, 8) for column in wide]
    fields.append(size.astype(np.uint8)[:, None])
    if ends is not None:
        fields.append((ends[first] & 56 | ends[first + size - 1] & 7).astype(np.uint8)[:, None])
    table = np.concatenate(fields, axis=1)
    heads = to_planes(table, start, rows)

    length = _packed_bytes(size, k)
    bits = np.append(base.astype(np.uint8), np.zeros(8, np.uint8))
    four = bits[:-3] << 6 | bits[1:-2] << 4 | bits[2:-1] << 2 | bits[3:]
    begin = np.cumsum(length) - length
    packed = four[np.repeat(at[first] - 4 * begin, length) + 4 * np.arange(int(length.sum()))]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, start) if len(start) else values

    sizes = summed(length)
    cut = np.append(0, np.cumsum(sizes)).tolist()
    codec = _codec()
    columns = [
        pa.array(bucket[start].astype(np.int32)),
        pa.array(summed(size).astype(np.int32)),
        binaries(heads, rows * table.shape[1]),
        pa.array(sizes.astype(np.int32)),
        pa.array([codec.compress(packed[low:high], asbytes=True) for low, high in zip(cut, cut[1:])], pa.binary()),
    ]
    return pa.record_batch(columns, names=["bucket", "kmers", "heads", "size", "bases"])


def _codec() -> pa.Codec:
    # bases of text are no more even than its letters, which the shuffle's own compression does not use
    return pa.Codec("zstd", 1)


def _packed_bytes(size: np.ndarray, k: int) -> np.ndarray:
    return (size + k + 2) // 4


def binaries(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """``data`` cut into values of these lengths."""
    ends = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def to_planes(table: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bytes of each group of rows: all first ones, then all second ones, ...

    Equal bytes then stand together, which the shuffle's compression needs.
    """
    data = np.empty(table.size, np.uint8)
    for byte, to in enumerate(_planes(start, rows, table.shape[1])):
        data[to] = table[:, byte]
    return data


def from_planes(data: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The table of :func:`to_planes`."""
    table = np.empty((len(data) // width, width), np.uint8)
    for byte, at in enumerate(_planes(np.cumsum(rows) - rows, rows, width)):
        table[:, byte] = data[at]
    return table


def _planes(start: np.ndarray, rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    to = np.repeat(start * (width - 1), rows) + np.arange(int(rows.sum()))
    step = np.repeat(rows, rows)
    for byte in range(width):
        yield to + byte * step


@dataclass
class PieceChunk:
    """k-mers of whole buckets, or those of one bucket with some hashes. All places of a k-mer are in one chunk."""

    number: int
    wide: list[np.ndarray]  #: of each piece
    ends: np.ndarray | None
    size: np.ndarray
    of: np.ndarray  #: piece of each k-mer
    place: np.ndarray  #: and its place there
    _at: np.ndarray
    _data: np.ndarray

    def bases(self, skip: int, width: int) -> np.ndarray:
        """Packed ``width`` bases (31 at most) from ``skip`` bases behind the begin of each k-mer."""
        return _bases(self._data, self._at + skip, width)


def _bases(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.int64)
    at = np.maximum(at, 0)
    byte, shift = at >> 2, ((at & 3) << 1).astype(np.uint64)
    eight = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
    value = eight[byte].astype(np.uint64) << shift
    if 2 * width > 58:
        value |= data[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift)
    return (value >> np.uint64(64 - 2 * width)).astype(np.int64)


def piece_chunks(batches: Iterator[pa.RecordBatch], k: int, wide: int, ends: bool = False) -> Iterator[PieceChunk]:
    """The k-mers of :func:`deal_pieces` rows sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total, first, last, codec = 0, 0, None, _codec()
    for batch in batches:
        heads, bases = (slices(batch.column(i)) for i in (2, 4))
        numbers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for bucket, kmers, length, head, packed in zip(*numbers, heads, bases):
            if bucket != last:
                if total >= CHUNK_ROWS:
                    yield from _listed(first, held, total, k, wide, ends)
                    held, total = [], 0
                    give_back()
                last = bucket
                first = first if held else bucket
            held.append((head, np.frombuffer(codec.decompress(packed, length), np.uint8)))
            total += kmers
    if held:
        yield from _listed(first, held, total, k, wide, ends)


def slices(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a binary column, copied, so that the batch is not held."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    values = np.frombuffer(data or b"", np.uint8)
    return (values[low:high].copy() for low, high in zip(at, at[1:]))


def _listed(
    bucket: int, held: list[tuple[np.ndarray, np.ndarray]], total: int, k: int, wide: int, ends: bool
) -> Iterator[PieceChunk]:
    width = 8 * wide + 1 + ends
    heads = np.concatenate([head for head, _ in held])
    data = np.concatenate([packed for _, packed in held] + [np.zeros(16, np.uint8)])
    rows = np.array([len(head) // width for head, _ in held])
    table = from_planes(heads, rows, width)
    columns = [table[:, 8 * i : 8 * i + 8].copy().view("<i8").ravel() for i in range(wide)]
    size = table[:, 8 * wide].astype(np.int64)
    code = table[:, 8 * wide + 1].astype(np.int64) if ends else None
    length = _packed_bytes(size, k)
    begin = 4 * (np.cumsum(length) - length)
    done = np.cumsum(size)

    def places(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(low, high), size[low:high])
        return of, np.arange(len(of)) + (done[low - 1] if low else 0) - (done - size)[of]

    parts = -(-total // PART_ROWS)
    for part in range(parts):
        if parts == 1:
            of, place = places(0, len(size))
        else:
            found, step = [], max(PART_ROWS // _PIECE_KMERS, 1)
            for low in range(0, len(size), step):
                of, place = places(low, min(low + step, len(size)))
                key = _bases(data, begin[of] + place, min(k, 31)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                kept = (key >> np.uint64(32)) % np.uint64(parts) == part
                found.append((of[kept], place[kept]))
            of, place = (np.concatenate(c) for c in zip(*found))
        if len(of):
            yield PieceChunk((bucket << _PART_BITS) + part, columns, code, size, of, place, begin[of] + place, data)
