"""Windows and classes from buckets of k-mers: the same as from sorted occurrences, in one shuffle."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_binning import read_table, skewed_reads
from test_hubs import genome_reads

from seqbin.operators import hubs, kmers
from seqbin.staging import stage


def members(rows):
    found = defaultdict(list)
    for hub, read in rows:
        found[hub].append(read)
    return sorted(sorted(reads) for reads in found.values())


@pytest.mark.parametrize("k,m,letters", [(8, 3, "ACGT"), (6, 4, "AC"), (9, 1, "ACGT")])
def test_windows_equal_those_of_sorted_occurrences(spark, k, m, letters):
    for reads in (skewed_reads(), genome_reads(k, letters)):
        table = read_table(spark, reads).repartition(3)
        # every third read comes in two rows, the second with some of the same k-mers
        split = table.filter("read_id % 3 = 0").select("*", F.lit(2).alias("parts"))
        table = table.filter("read_id % 3 <> 0").select("*", F.lit(1).alias("parts")).unionByName(split).unionByName(split)
        occurrences = hubs.shared_occurrences(table, k, m)
        want = members((r.hub, r.read_id) for r in hubs.shared_windows(occurrences, m).collect())
        rows = stage(hubs.window_rows(table, k, m, 4096), "window-rows")
        assert members((r.id, r.read_id) for r in rows.filter(f"kind = {hubs.HUB}").collect()) == want
        contexts = {(r.read_id, r.kmer, r.left, r.tail) for r in hubs.read_contexts(occurrences, m).collect()}
        kept = rows.filter(f"kind = {hubs.CLASS}").collect()
        assert {(r.read_id, r.kmer, r.left, r.tail) for r in kept} <= contexts
        assert len({(r.read_id, r.kmer) for r in kept}) == len(kept)
        places = defaultdict(list)
        for r in kept:
            places[r.id, r.kmer, r.left, r.tail, r.total].append(r.position)
        assert all(sorted(at) == list(range(key[-1])) for key, at in places.items())


def test_one_shuffle_and_no_join(spark):
    table = read_table(spark, genome_reads(1))
    plan = hubs.window_rows(table, 8, 3, 4096)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_kmers_that_agree_around_are_not_listed(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(80))
    table = read_table(spark, {i: [[text]] for i in range(50)})
    kinds = [r.kind for r in hubs.window_rows(table, 10, 4, 20).collect()]
    assert kinds == [hubs.HUB] * 50


def test_buckets_keep_kmers_together(monkeypatch):
    monkeypatch.setattr(kmers, "_BUCKET_ROWS", 50)
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 40, 90), rng.integers(0, 9, 90)) for _ in range(4)]
    table = pa.concat_tables([pa.Table.from_batches([kmers.deal_to_buckets(list(r))]) for r in rows]).sort_by("bucket")
    chunks = list(kmers.bucket_chunks(iter(table.to_batches(max_chunksize=7))))
    seen = [set(c[0].tolist()) for _, c in chunks]
    assert len(chunks) > 1 and sum(map(len, seen)) == len(set().union(*seen))
    assert len({first for first, _ in chunks}) == len(chunks)
    got = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*(c for _, c in chunks)))))
    assert got == sorted((a, b) for x, y in rows for a, b in zip(x.tolist(), y.tolist()))
    assert not len(kmers.deal_to_buckets([np.zeros(0, np.int64)] * 2))
