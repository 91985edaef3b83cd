"""Canonical k-mer counts as histograms: against counting by hand, and how much is shuffled."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqbin.operators import kmers
from seqbin.operators.vectors import profile_vectors

PAIR = str.maketrans("ACGT", "TGCA")


def _by_hand(rows, k):
    counts = Counter()
    for key, run in rows:
        for i in range(len(run or "") - k + 1):
            word = run[i : i + k]
            if set(word) <= set("ACGT"):
                counts[key, min(word, word.translate(PAIR)[::-1])] += 1
    return counts


def _rows(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "hot", "hot", "a", "b", f"k{i}"]), "".join(rng.choices("ACGTN", (5, 5, 5, 5, 1), k=rng.randrange(0, 60)))) for i in range(n)]
    return rows + [("none", None), ("short", "ACG"), ("a", ""), ("pal", "AATTAATT")]


@pytest.mark.parametrize("k", [1, 3, 4, 5, 6])
def test_profile_equals_counting_by_hand(spark, k):
    rows = _rows(k)
    table = spark.createDataFrame(rows, "key string, run string").repartition(5)
    got = {(r.key, r.kmer): (r.weight, r.forward) for r in kmers.kmer_profile(table, k).collect()}
    want = _by_hand(rows, k)
    assert {x: n for x, (_, n) in got.items()} == dict(want)
    assert all(w == n * (2 if x[1] == x[1].translate(PAIR)[::-1] else 1) for x, (w, n) in got.items())


@pytest.mark.parametrize("k", [4, 6])
def test_vectors_follow_the_counts(spark, k):
    rows = [r for r in _rows(9) if r[0] is not None]
    got = {r.key: r.features for r in profile_vectors(spark.createDataFrame(rows, "key string, run string"), k).collect()}
    numbers, want = kmers.canonical_numbers(k), {}
    for (key, word), n in _by_hand(rows, k).items():
        code = int("".join(str("ACGT".index(c)) for c in word), 4)
        vector = want.setdefault(key, np.zeros(numbers.max() + 1))
        vector[numbers[code]] = n
    assert set(got) == set(want)
    for key, vector in want.items():
        twice = np.where(np.bincount(numbers) == 1, 2, 1)
        assert got[key] == (vector * twice / vector.sum()).tolist()


def test_no_runs(spark):
    assert kmers.kmer_profile(spark.createDataFrame([], "key bigint, run string")).count() == 0
    assert profile_vectors(spark.createDataFrame([(1, "")], "key bigint, run string")).count() == 0
    with pytest.raises(ValueError):
        kmers.kmer_histograms(spark.createDataFrame([], "key bigint, run string"), 6)


def test_a_hot_key_is_shuffled_as_one_row_per_task(spark):
    runs = spark.range(0, 20_000, 1, 4).select(F.lit(7).alias("key"), F.lit("ACGTTGCAAC" * 4).alias("run"))
    counted = runs.mapInArrow(
        lambda batches: kmers._count_batches(batches, 4, 136), "key int, counts array<bigint>"
    )
    assert counted.count() == 4
    (row,) = kmers.kmer_histograms(runs).collect()
    assert row.key == 7 and sum(row.counts) == 20_000 * 37


def test_the_sum_goes_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = _rows(21, 60)
        table = spark.createDataFrame(rows, "key string, run string").repartition(7)
        got = {(r.key, r.kmer): r.forward for r in kmers.kmer_profile(table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == dict(_by_hand(rows, 4))
