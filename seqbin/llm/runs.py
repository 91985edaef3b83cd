"""Periodic runs of words, by branching tandem repeats on an enhanced suffix array.

The words of a slice of texts become numbers; texts have no number in common, so one
suffix array (``sa``, its inverse ``isa`` and the ``lcp`` of neighbours) serves the whole
slice and no match crosses texts. It is made by prefix doubling: only suffixes that still
share a rank are sorted again.

Two suffixes i and i + d whose common prefix has d words are a square of period d that
the next word ends: a *branching* tandem repeat. Both stand in the LCP interval of depth
d, in different children of it. So for each interval, split at one of its minima, the
suffixes of the smaller side are looked at, and ``isa[i + d]`` and ``isa[i - d]`` tell
whether the partner stands on the other side. That is O(n log n) look-ups without any
tree. A square is then rotated to the left as far as words d apart agree. Rotations of one
square, and squares of multiples of its period, end up as the same stretch and are merged
into one run with the smallest period.

Defined cases: a null text or one without words has no runs (and the digests of nothing); a
null doc_id, or rows that repeat one, are handled like any other; long texts are handled
whole, alone in their slice (about ``4 * log2(longest repeat) + 40`` bytes a word); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a run has at least this many words and this many periods
MIN_WORDS, MIN_PERIODS = 6, 4
#: words handled by one suffix array; a longer single text is handled alone
SLICE_WORDS = 100_000


# --- enhanced suffix array ---------------------------------------------------------


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sa, isa, lcp)`` of numbers; no suffix passes its ``ends[i]``.

    ``lcp[k]`` is the common prefix of ``sa[k - 1]`` and ``sa[k]``; ``lcp[0]`` is 0. Texts must
    have no number in common.
    """
    n = len(words)
    sa = np.argsort(words, kind="stable")
    by_word = words[sa]
    heads = np.ones(n, bool)
    heads[1:] = by_word[1:] != by_word[:-1]
    first = np.flatnonzero(heads)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    history = [rank.astype(np.int32 if n < 1 << 31 else np.int64)]
    length = 1
    while True:
        # places whose rank is shared: they alone are sorted by the next words
        shared = ~heads
        shared[:-1] |= shared[1:]
        places = np.flatnonzero(shared)
        if not len(places):
            break
        at = sa[places]
        after = at + length
        inside = after < ends[at]
        key = np.full(len(at), -1, np.int64)
        key[inside] = rank[after[inside]]
        group = rank[at]
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        sa[places] = at
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        heads[places] = new
        first = places[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(at)))
        rank[at] = np.repeat(first, counts)
        history.append(rank.astype(history[0].dtype))
        length *= 2
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    # neighbours agree on the words of a level if they have the same rank there
    lcp = np.zeros(n, np.int64)
    left, right = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for level in reversed(range(len(history))):
        a, b = left + common, right + common
        # one of the two may have ended: then there is nothing more in common
        inside = (a < ends[left]) & (b < ends[right])
        ranks = history[level]
        same = np.zeros(len(common), bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        common[same] += 1 << level
    lcp[1:] = common
    return sa, isa, lcp


def _reach(lcp: np.ndarray, strict: bool) -> np.ndarray:
    """For each k the nearest place before it with a smaller value (or equal, if ``strict``); -1 if none.

    All pointers jump at once: whatever a pointer skips is not smaller than what it came from.
    """
    n = len(lcp)
    before = np.arange(-1, n - 1)
    open_ = np.arange(n)
    while len(open_):
        at = before[open_]
        value = lcp[np.maximum(at, 0)]
        own = lcp[open_]
        blocked = (at >= 0) & ((value > own) if strict else (value >= own))
        open_ = open_[blocked]
        before[open_] = before[before[open_]]
    return before


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of every branching tandem repeat that ends inside its text."""
    n = len(sa)
    splits = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(splits):
        return none, none
    # [low, k - 1] and [k, high]: the two sides of the interval that k splits; each pair of
    # suffixes is parted by exactly one k, also where minima tie
    low = _reach(lcp, strict=False)[splits]
    low = np.maximum(low, 0)
    high = (n - 1 - _reach(lcp[::-1], strict=True))[::-1][splits] - 1
    left, right = splits - low, high - splits + 1
    use_left = left <= right
    size = np.where(use_left, left, right)
    begin = np.where(use_left, low, splits)
    other_low = np.where(use_left, splits, low)
    other_high = np.where(use_left, high, splits - 1)
    depth = lcp[splits]
    starts, periods = [], []
    # expand the smaller sides, some splits at a time
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(0, total[-1], 1 << 20), "left")
    cuts = np.append(np.unique(cuts), len(splits))
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = size[a:b]
        of = np.repeat(np.arange(a, b), part)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(part) - part, part)
        i = sa[begin[of] + offset]
        d = depth[of]
        for at, square in ((i + d, i), (i - d, i - d)):
            good = (at >= 0) & (at < n)
            place = isa[np.clip(at, 0, n - 1)]
            good &= (place >= other_low[of]) & (place <= other_high[of])
            starts.append(square[good])
            periods.append(d[good])
    return np.concatenate(starts), np.concatenate(periods)


# --- runs ------------------------------------------------------------------------------


def _rotate(words: np.ndarray, begin: int, start: int, period: int) -> int:
    """How far to the left the square at ``start`` rotates; ``begin`` is the start of its text."""
    width = 64
    while start > begin:
        low = max(begin, start - width)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start = low
        width *= 2
    return start


def find_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs, sorted; ``begins`` and ``ends`` are those of a word's text."""
    if len(words) < MIN_WORDS:
        return []
    start, period = branching_squares(*suffix_array(words, ends), ends)
    if not len(start):
        return []
    end = start + 2 * period
    # a run of the wanted length goes this far back; some of its words tell quickly
    first = end - np.maximum(MIN_WORDS, MIN_PERIODS * period)
    kept = first >= begins[start]
    for share in (0, 1, 2, 3):
        start, period, end, first = start[kept], period[kept], end[kept], first[kept]
        at = first + (start - first) * share // 4
        kept = words[at] == words[at + period]
    start, period, end, first = start[kept], period[kept], end[kept], first[kept]
    found: dict[tuple[int, int], int] = {}
    # squares with the same end, shortest period first: a multiple of a known period, no
    # longer than half of its run, is a square of the same run
    last_end, known = -1, []
    for at in np.lexsort((period, end)).tolist():
        e, p, s = int(end[at]), int(period[at]), int(start[at])
        if e != last_end:
            last_end, known = e, []
        if any(p % q == 0 and 2 * p <= e - b for b, q in known):
            continue
        if np.any(words[first[at] : s] != words[first[at] + p : s + p]):
            continue
        b = _rotate(words, int(begins[s]), int(first[at]), p)
        known.append((b, p))
        found[(b, e)] = min(p, found.get((b, e), p))
    return sorted((b, e, p) for (b, e), p in found.items())


def _repeated(words: list, doc_id: int | None) -> list:
    """The words of a document, with the stretch that its id asks to be made periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of some documents at a time; words are split at ASCII white space."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py()
            words = _repeated(raw.encode("utf-8").split() if raw else [], doc_id)
            if ids and size + len(words) > SLICE_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
        if ids:
            yield ids, texts


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words as numbers, none of which occurs in two texts, and where each text begins."""
    offsets = np.cumsum([0, *map(len, texts)])
    numbers = np.empty(offsets[-1], np.int64)
    used = 0
    for words, at in zip(texts, offsets.tolist()):
        known: dict[bytes, int] = {}
        numbers[at : at + len(words)] = [known.setdefault(w, used + len(known)) for w in words]
        used += len(known)
    return numbers, offsets


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, sorted by start, then period."""
    words, offsets = _numbers(texts)
    sizes = np.diff(offsets)
    begins, ends = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in find_runs(words, begins, ends):
        doc = int(np.searchsorted(offsets, start, "right")) - 1
        out[doc].append((start - int(offsets[doc]), end - start, period))
    for runs in out:
        runs.sort(key=lambda run: (run[0], run[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)
_NAMES = [column.split()[0] for column in _SCHEMA.split(",")]


def _report(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    longest = (None,) * 4
    if runs:
        start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]))
        longest = (start, length, period, 1000 * length // period)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(collapse(words, runs))
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs per row of ``(doc_id, text)``, after the repetition that some ids ask for.

    ``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256)``; the four columns of the longest run are null without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            rows = [_report(*row) for row in zip(ids, texts, text_runs(texts))]
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
            yield pa.record_batch(arrays, names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _SCHEMA
    )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, text)``: texts without repeated periods, words joined by one space.

    Texts without runs, and null, stay as they are. No id changes a text here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            words = [text.encode("utf-8").split() if text else [] for text in raw]
            counts, out = [], []
            for at in range(0, len(raw), 64):
                some = words[at : at + 64]
                for text, parts, runs in zip(raw[at:], some, text_runs(some)):
                    counts.append(len(runs))
                    out.append(b" ".join(collapse(parts, runs)).decode("utf-8") if runs else text)
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_runs", "text"]
            )

    ids, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    return docs.select(ids, text).mapInArrow(run, "doc_id long, n_runs long, text string")
