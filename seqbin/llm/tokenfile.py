"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits, least significant first. Level 0 holds
the first chunk of every id, level k the (k+1)-th chunk of the ids that have one.
Each level has a bitmap of continuations and a rank directory (ones before every
512 bits), so the place of an id's next chunk is a rank query: any id is read
without decoding its neighbours.

A file is one segment: a header, a document directory and the levels. Segments are
rows of a Parquet table, so that Spark's committers take care of retried tasks and
any file system that Spark can write to will do. Documents are range-partitioned by
doc_id; a segment holds whole documents in ascending order.

Segment bytes, little endian: magic ``DAC1``, u32 documents, u64 ids, u32 levels;
doc_ids i64[], ids per document u64[]; per level u64 chunks, chunks u8[], bitmap
u8[ceil(chunks / 8)], directory u64[ceil(chunks / 512)].

Defined cases: a null or empty text has its end id only; long texts are encoded whole and
stay in one segment; a row without a doc_id has no place and is left out; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqbin.llm.pretokens import ODD, Remembered, splitter
from seqbin.staging import stage_path

CHUNK = 8
RANK_BITS = 512
#: a segment is closed when it holds this many ids
SEGMENT_IDS = 1 << 18
#: pre-tokens of one generation of a worker's memory (about 150 bytes each)
REMEMBER = 700_000
#: bytes of text per range partition of the writer
PARTITION_BYTES = 24_000_000

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(bitmap)] = bitmap
        per_block = _ONES[padded].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u8") if len(per_block) else np.zeros(0, "<u8")
        levels.append(
            struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes()
        )
        rest = more[on]
        if not len(rest):
            break
    head = b"DAC1" + struct.pack("<IQI", len(doc_ids), len(ids), len(levels))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), *levels])


class Segment:
    """Random and bulk access to the bytes of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a token segment")
        docs, self.size, levels = struct.unpack_from("<IQI", data, 4)
        at = 20
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            at += n + len(bitmap)
            directory = np.frombuffer(data, "<u8", -(-n // RANK_BITS), at)
            at += 8 * len(directory)
            self.levels.append((chunks, bitmap, directory))

    def get(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            byte, bit = i >> 3, i & 7
            if not bitmap[byte] >> bit & 1:
                break
            block = i // RANK_BITS
            before = _ONES[bitmap[block * RANK_BITS // 8 : byte]].sum(dtype=np.int64)
            i = int(directory[block]) + int(before) + int(_ONES[bitmap[byte] & ((1 << bit) - 1)])
        return value

    def all(self) -> np.ndarray:
        """All ids, as uint32."""
        out = np.zeros(self.size, np.uint32)
        at = np.arange(self.size)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on.
    """
    printable = {b for b in range(33, 256) if b not in range(127, 161) and b != 173}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_BYTE_ALPHABET = _byte_alphabet()


class LibraryEncoder:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once.

    Texts of plain characters are cut into pre-tokens here, by the byte-level
    pattern, and every new pre-token goes through the library; its ids are
    remembered. A text with any other character goes through the library whole,
    so that the library's own character classes decide. Strings of special tokens
    are ordinary text.
    """

    def __init__(self, tokenizer_path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path)
        library.encode_special_tokens = True
        self.library, self.merge = library, library.model.tokenize
        self.cut = splitter(public_tokenizers.PATTERN)
        self.known = Remembered(self._piece, remember)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """A pre-token goes straight to the library's model, in its byte alphabet."""
        return array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(_BYTE_ALPHABET))]).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, self.cut(text)))


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(tokenizer_path: str) -> LibraryEncoder:
    """One encoder per Python worker: it serves the tasks that follow too."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = LibraryEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode ``(doc_id, text)`` and write segments in ascending doc_id order.

    ``end_id`` closes every document. A null or empty text is only its end. Rows
    without a doc_id have no place in the order and are left out; rows that repeat
    one follow each other. Parts are numbered in the order of doc_id.
    """
    rows = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part, number = None, 0
        doc_ids: list[int] = []
        bodies: list[bytes] = []
        total = 0

        def segment() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in bodies], np.int64)
            data = pack_segment(np.array(doc_ids, np.int64), counts, np.frombuffer(b"".join(bodies), "<u4"))
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([total], pa.int64()), pa.array([data], pa.binary()),
                ],
                names=["part", "segment", "n_ids", "data"],
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py())
                doc_ids.append(doc_id)
                bodies.append(ids + end)
                total += len(ids) // 4 + 1
                if total >= SEGMENT_IDS:
                    yield segment()
                    number += 1
                    doc_ids, bodies, total = [], [], 0
        if doc_ids:
            yield segment()

    (
        rows.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(run, "part int, segment int, n_ids long, data binary")
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, segment int, n_ids long, data binary").parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, segment, before)``: ids in front of every segment.

    Sums run inside a part first; only one row per part meets in the global sum.
    """
    sizes = _stored(spark, path).select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = (
        sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(overall), zero).alias("part_start"))
    )
    own = F.coalesce(F.sum("n_ids").over(inside), zero)
    return (
        sizes.select("part", "segment", own.alias("own"))
        .join(parts, "part")
        .select("part", "segment", (F.col("own") + F.col("part_start")).alias("before"))
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` from the files; ``start`` counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, data in _segments(batches):
            segment = Segment(data)
            ends = np.concatenate(([0], np.cumsum(segment.counts)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(segment.all().astype(np.int64)))
            yield _rows(part, number, segment, ends, [lists], ["ids"])

    rows = _stored(spark, path).select("part", "segment", "data").mapInArrow(
        run, "part int, segment int, doc_id long, own long, ids array<long>"
    )
    return rows.join(_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("own")).alias("start"), "ids"
    )


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, read from the files.

    ``ids_crc32`` is that of the document's ids as little-endian unsigned 32-bit
    numbers. Segments are decoded where they lie; only one small row per document is
    joined with the segments' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, data in _segments(batches):
            segment = Segment(data)
            raw = memoryview(segment.all().astype("<u4").tobytes())
            ends = np.concatenate(([0], np.cumsum(segment.counts)))
            at = ends.tolist()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            values = [pa.array(segment.counts), pa.array(sums, pa.int64())]
            yield _rows(part, number, segment, ends, values, ["n_tokens", "ids_crc32"])

    rows = _stored(spark, path).select("part", "segment", "data").mapInArrow(
        run, "part int, segment int, doc_id long, own long, n_tokens long, ids_crc32 long"
    )
    return rows.join(_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32"
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(3))


def _rows(part: int, number: int, segment: Segment, ends: np.ndarray, values: list, names: list) -> pa.RecordBatch:
    n = len(segment.doc_ids)
    place = [pa.array(np.full(n, x), pa.int32()) for x in (part, number)]
    return pa.record_batch(
        [*place, pa.array(segment.doc_ids), pa.array(ends[:-1]), *values],
        names=["part", "segment", "doc_id", "own", *names],
    )


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write to a new stage path, read back and report (see :func:`token_report`)."""
    spark = docs.sparkSession
    path = stage_path(spark, "token-files")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_report(spark, path)
