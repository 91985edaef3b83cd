"""Ends of runs added up per pair, and equal rows found by marks of their hash."""

import numpy as np

from seqbin.operators import kmers, linked


def summed(src, dst, delta, m):
    sums = {}
    for a, b, d in zip(src.tolist(), dst.tolist(), delta.tolist(), strict=True):
        sums[a, b] = sums.get((a, b), 0) + d
    return [(a, b, w) for (a, b), w in sorted(sums.items()) if w >= m]


def test_pairs_are_added_up_in_order():
    draw = np.random.default_rng(3)
    src, dst, delta = draw.integers(0, 30, 4000), draw.integers(30, 60, 4000), draw.integers(-3, 6, 4000)
    got = linked._add_pairs(src, dst, delta, 5)
    assert [tuple(r.values()) for r in got.to_pylist()] == summed(src, dst, delta, 5)


def test_pairs_that_share_their_number_are_told_apart(monkeypatch):
    monkeypatch.setattr(linked, "_pair_key", lambda src, dst: (src + dst).astype(np.uint64))
    draw = np.random.default_rng(4)
    src, dst, delta = draw.integers(0, 9, 500), draw.integers(9, 18, 500), draw.integers(-1, 4, 500)
    got = linked._add_pairs(src, dst, delta, 2)
    assert [tuple(r.values()) for r in got.to_pylist()] == summed(src, dst, delta, 2)


def test_no_row_is_searched_among_all_repeated_ones(monkeypatch):
    """Marks stand for the search; with a single bit of them the result is the same."""
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 50, 3000), draw.integers(0, 40, 3000)
    want = sorted({pair: i for i, pair in reversed(list(enumerate(zip(a.tolist(), b.tolist()))))}.values())
    monkeypatch.setattr(np, "searchsorted", None)
    assert kmers.first_places(a, b).tolist() == want
    monkeypatch.setattr(kmers, "_MARK_BITS", 1)
    assert kmers.first_places(a, b).tolist() == want
