"""Vectors of any size in the exact top-k search, against Python integers."""

import math

import numpy as np
import pytest

from seqbin.llm import topk


def _brute(rows, k, every):
    whole = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            whole.setdefault(i, []).append([math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in e])
    out = []
    for q in whole:
        if q % every == 0:
            found = []
            for i, several in whole.items():
                found += [(-sum(a * b for a, b in zip(v, min(whole[q]))), i) for v in several if i != q and len(v) == len(min(whole[q]))]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [16_384, 30])
def test_components_of_any_size(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 4), 2)]) for i in range(120)]
    for i, big in ((50, 70000.0), (51, -70000.0), (60, 1e12), (61, 1e12), (62, -3e12), (70, 1e200), (71, 1.7e308), (72, -1e200)):
        rows[i][1][i % 4] = big
    rows += [(200, []), (201, []), (210, []), (205, [1.0]), (300, [2.0]), (301, [70000.5])]
    rows += [(400, None), (410, [1.0, None, 2.0, 3.0]), (None, [1.0, 2.0, 3.0, 4.0]), (420, [float("nan")] * 4), (430, [float("inf")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(vectors, 5, 10).collect()))
    assert got == _brute(rows, 5, 10)
    assert {q for q, *_ in got} >= {50, 60, 70, 200, 300} and {v for _, _, v, _ in got} >= {61, 71, 201}


def test_index_gives_back_its_values():
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 23), 1 << 23, (130, 5))
    low, slices = topk.build_slices(values)
    assert (topk.slice_values(low, slices, 130) == values).all()


def test_products_in_limbs():
    rng = np.random.default_rng(2)
    for bits in (20, 40, 45, 47, 60):
        values, weights = rng.integers(-(1 << bits), 1 << bits, (20, 6)), rng.integers(-(1 << bits), 1 << bits, 6)
        want = [sum(int(a) * int(b) for a, b in zip(row, weights)) for row in values]
        assert topk.exact_products(values, weights).tolist() == want
