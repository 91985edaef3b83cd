"""Byte-level BPE encoding and decoding with a bitmap queue over merge ranks.

Within a pre-token the byte pieces form a linked list. Every pair that can merge
is filed under its rank; a hierarchical bitmap (256-bit words below, one summary bit
per word above) tells by find-first-set which rank comes next. A bucket holds
list positions; entries whose pair has changed since are stale and skipped.

There are two forms of the same queue. The new pre-tokens of many texts share one: their
lists lie one after another, and when a rank comes up its first place in each of them is
merged, all at once with numpy. (No pre-token can have a lower rank then, and its other
places of that rank stay in the bucket, because a merge may bring up a lower one.) A
long pre-token has a queue of its own, whose buckets are heaps: a merge costs a constant
number of bitmap steps and a heap step, so n bytes take O(n log n) and not n passes.

Defined cases: a null or empty text has no ids and the digests of nothing; a null doc_id, or
rows that repeat one, are encoded like any other; long texts and long pre-tokens are encoded
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.llm.memory import give_back
from seqbin.llm.pretokens import Remembered, splitter

#: pre-tokens of one generation of a Python worker's memory (about 230 bytes each, two generations)
REMEMBER = 1_000_000
#: pre-tokens of more bytes than this have a queue of their own
SHARED_BYTES = 64
#: characters of texts whose new pre-tokens share a queue
SLICE_CHARS = 6_000_000
#: bits of a word of the lower bitmap level
WORD_LOG = 8
WORD = 1 << WORD_LOG
WORD_MASK = WORD - 1
_BIT = [1 << i for i in range(WORD)]


class BytePairs:
    """Merge ranks of a vocabulary file, as encoder and decoder of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: rank of every pair of bytes
        self.double = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    @classmethod
    def from_file(cls, path: str) -> BytePairs:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            return cls({base64.b64decode(p[0]): int(p[1]) for p in pairs if p})

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the lowest rank first, leftmost among equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        get = ranks.get
        end = list(range(1, n + 2))  # end[i]: where the part that begins at i ends
        before = list(range(-1, n))
        double = self.double
        pair = [double[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of part i with the next one
        pair.append(-1)
        ids = list(map(self.single.__getitem__, piece))  # id of part i: the rank of its last merge
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # lower level of the bitmap: non-empty words only
        top = 0  # upper level: one bit per word
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD_LOG
                    if word in words:
                        words[word] |= _BIT[rank & WORD_MASK]
                    else:
                        words[word] = _BIT[rank & WORD_MASK]
                        top |= 1 << word
        # positions were filed in ascending order, so every bucket is a heap already
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << WORD_LOG) | ((bits & -bits).bit_length() - 1)
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                k = end[i] = end[j]
                pair[j] = -1
                ids[i] = rank
                left = before[i]
                if k < n:
                    before[k] = i
                    changed = (i, left) if left >= 0 else (i,)
                else:
                    pair[i] = -1
                    changed = (left,) if left >= 0 else ()
                for at in changed:
                    found = pair[at] = get(piece[at : end[end[at]]], -1)
                    if found < 0:
                        continue
                    lower = lower or found < rank
                    if found in buckets:
                        heappush(buckets[found], at)
                    else:
                        buckets[found] = [at]
                        new = found >> WORD_LOG
                        if new in words:
                            words[new] |= _BIT[found & WORD_MASK]
                        else:
                            words[new] = _BIT[found & WORD_MASK]
                            top |= 1 << new
            if not bucket:
                del buckets[rank]
                words[word] ^= _BIT[rank & WORD_MASK]
                if not words[word]:
                    del words[word]
                    top ^= 1 << word
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return tuple(out)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys ``left << 32 | right`` of all pairs of parts that make a part, and their ranks."""
        keys, found = [], []
        get = self.ranks.get
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left = get(piece[:cut])
                right = get(piece[cut:]) if left is not None else None
                if right is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        return np.array(keys, np.int64)[order], np.array(found, np.int64)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, -1 where they do not merge."""
        keys, ranks = self.pairs
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], -1)

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many pre-tokens; those that are no part themselves share one queue."""
        whole = list(map(self.ranks.get, pieces))
        split = iter(self._encode_shared([p for p, rank in zip(pieces, whole) if rank is None]))
        return [next(split) if rank is None else (rank,) for rank in whole]

    def _encode_shared(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if not pieces:
            return []
        if min(self.single) < 0 or not len(self.pairs[0]):
            return [self.encode_piece(piece) for piece in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        of = np.repeat(np.arange(len(pieces)), sizes)
        ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = n, -1
        pair = np.full(n + 1, -1, np.int64)  # rank of the part at i with the next one; n stands for none
        inner = np.flatnonzero(after < n)
        pair[inner] = self._rank(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        # buckets: places in order, and lists of what was filed since
        filed = np.flatnonzero(pair >= 0)
        filed = filed[np.argsort(pair[filed], kind="stable")]
        ranks, begins = np.unique(pair[filed], return_index=True)
        none = np.zeros(0, np.int64)
        buckets: dict[int, np.ndarray] = dict(zip(ranks.tolist(), np.split(filed, begins[1:]))) if len(filed) else {}
        later: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        for rank in buckets:
            words[rank >> WORD_LOG] = words.get(rank >> WORD_LOG, 0) | _BIT[rank & WORD_MASK]
        top = sum(1 << word for word in words)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << WORD_LOG) | ((bits & -bits).bit_length() - 1)
            places = buckets.pop(rank, none)
            added = later.pop(rank, None)
            if added is not None:
                added = np.array(added, np.int64)
                places = np.concatenate([places, added]) if len(places) else added
                places.sort()
            places = places[pair[places] == rank]  # the others are stale
            owner = of[places]
            first = np.ones(len(places), bool)
            first[1:] = owner[1:] != owner[:-1]
            rest = places[~first]
            if len(rest):
                buckets[rank] = rest
            else:
                words[word] ^= _BIT[rank & WORD_MASK]
                if not words[word]:
                    del words[word]
                    top ^= 1 << word
            i = places[first]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            alive[j] = False
            pair[j] = -1
            ids[i] = rank
            more = k < n
            before[k[more]] = i[more]
            pair[i[~more]] = -1
            left = before[i]
            has_left = left >= 0
            at = np.concatenate([i[more], left[has_left]])
            found = self._rank(ids[at], ids[after[at]])
            pair[at] = found
            good = found >= 0
            for place, new in zip(at[good].tolist(), found[good].tolist()):
                if new in later:
                    later[new].append(place)
                    continue
                later[new] = [place]
                in_word = new >> WORD_LOG
                if in_word in words:
                    words[in_word] |= _BIT[new & WORD_MASK]
                else:
                    words[in_word] = _BIT[new & WORD_MASK]
                    top |= 1 << in_word
        kept = np.flatnonzero(alive)
        counts = np.bincount(of[kept], minlength=len(pieces))
        flat, out, at = ids[kept].tolist(), [], 0
        for count in counts.tolist():
            out.append(tuple(flat[at : at + count]))
            at += count
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Splits texts by a pattern and encodes each match, remembering short ones."""

    def __init__(self, pairs: BytePairs, pattern: str, remember: int = REMEMBER):
        self.pairs = pairs
        self.split = splitter(pattern)
        self.known = Remembered(lambda piece: pairs.encode_piece(piece.encode("utf-8")), remember)
        self.decimal = {i: b"%d" % i for i in pairs.bytes_of}

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text or ""))))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of some texts; their new pre-tokens are encoded together first."""
        split = [self.split(text or "") for text in texts]
        known, pairs = self.known, self.pairs
        new = {piece for pieces in split for piece in pieces if piece not in known and piece not in known.older}
        raw = {piece: piece.encode("utf-8") for piece in new}
        shared = [piece for piece in new if len(raw[piece]) <= SHARED_BYTES]
        fresh = dict(zip(shared, pairs.encode_many([raw[piece] for piece in shared])))
        single = known.encode
        known.encode = lambda piece: fresh[piece] if piece in fresh else single(piece)
        for pieces in split:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))
        known.encode = single


_encoders: dict[tuple[str, str, int], TextEncoder] = {}


def _encoder(ranks_path: str, pattern: str, remember: int) -> TextEncoder:
    """One encoder per Python worker: it serves the tasks that follow too."""
    key = (ranks_path, pattern, remember)
    if key not in _encoders:
        _encoders[key] = TextEncoder(BytePairs.from_file(ranks_path), pattern, remember)
    return _encoders[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, remember: int = REMEMBER, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)`` per row of ``(doc_id, text)``.

    Like :func:`encode_digests`, with the ids themselves. ``remember`` and ``slice_chars``
    trade the memory of the Python workers for time; the result does not depend on them.
    """
    return _encoded(docs, ranks_path, pattern, remember, slice_chars, keep_ids=True)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, remember: int = REMEMBER) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``(doc_id, text)``.

    Digests are lowercase hex: of the decimal ids joined by commas, and of the
    decoded bytes. A null or empty text has no ids (digests of nothing). Rows that
    repeat a doc_id, and null ids, are encoded like any other. ``ranks_path`` must be
    readable on all executors (it comes with the tokenizer package).
    """
    return _encoded(docs, ranks_path, pattern, remember, SLICE_CHARS, keep_ids=False)


def _slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of about ``chars`` characters of text; a longer single text is handled alone."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _encoded(
    docs: DataFrame, ranks_path: str, pattern: str, remember: int, slice_chars: int, keep_ids: bool
) -> DataFrame:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, remember)
        sha, decimal = hashlib.sha256, encoder.decimal
        for batch in batches:
            for some in _slices(batch, slice_chars):
                counts, of_ids, of_bytes, kept = [], [], [], []
                for ids in encoder.encode_all(some.column(1).to_pylist()):
                    counts.append(len(ids))
                    of_ids.append(sha(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                    of_bytes.append(sha(encoder.pairs.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.array(ids, np.int32))
                columns = [some.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=names)
                del counts, of_ids, of_bytes, kept, columns
                give_back()

    ids = F.col("doc_id").cast("long").alias("doc_id")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(ids, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
