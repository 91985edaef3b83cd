"""Word and shingle hashes of whole Arrow batches, with numpy.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), with
A-Z in lower case. Words get 64-bit polynomial hashes; a shingle combines the
hashes of consecutive words. The tables come from a fixed seed, so every task
of every run gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once; a longer single text is handled alone
SLICE_BYTES = 1 << 20
MAX_SHINGLE = 16

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, MAX_SHINGLE, dtype=np.uint64) | np.uint64(1)
_LENGTH = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    kept = _powers.get(name)
    if kept is None or len(kept) < n:
        kept = np.full(n, base, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if n <= 2 * SLICE_BYTES:
            _powers[name] = kept
    return kept[:n]


@dataclass
class Words:
    """The words of some texts: one hash and one text number per word, in order."""

    texts: int
    doc: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(from, to)`` ranges of about SLICE_BYTES of text each."""
    sizes = np.zeros(len(texts), np.int64)
    lengths = pc.binary_length(texts).fill_null(0)
    sizes[:] = lengths.to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def words(texts: pa.Array) -> Words:
    """Words of a slice; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    none = np.zeros(0, np.int64)
    if data is None or ends[-1] == ends[0]:
        return Words(len(texts), none, none.astype(np.uint64))
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    space = _SPACE[raw]
    first = ~space
    after = np.ones(len(raw), bool)
    after[1:] = space[:-1]
    after[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(first & after)
    if not len(starts):
        return Words(len(texts), none, none.astype(np.uint64))
    terms = _BYTE[raw] * _power("up", _BASE, len(raw))
    sums = np.add.reduceat(terms, starts) * _power("down", _BASE_INVERSE, len(raw))[starts]
    return Words(len(texts), np.searchsorted(at, starts, "right") - 1, mix(sums))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, hash)`` of the distinct shingles, sorted by both.

    A text of fewer words, but not none, is one shingle.
    """
    counts = found.counts
    begin = np.concatenate(([0], np.cumsum(counts)))
    n = len(found.hash)
    total = np.zeros(n, np.uint64)
    place = np.arange(n) - begin[found.doc]
    left = counts[found.doc] - place
    for j in range(size):
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = found.hash[j:] * _PLACE[j]
        total += np.where(left > j, part, np.uint64(0))
    used = np.minimum(counts[found.doc], size)
    keep = (left >= size) | ((counts[found.doc] < size) & (place == 0))
    value = mix(total + used.astype(np.uint64) * np.uint64(_LENGTH))[keep]
    doc = found.doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new]
