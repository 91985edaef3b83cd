"""The overlap graph as shared windows: the same graph and groups as from listed pairs."""

import itertools
import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F
from test_binning import read_table, skewed_reads

from seqbin import BinningParams
from seqbin.operators.graph import attach_components, connected_components
from seqbin.operators.groups import seed_groups_hubs, seed_groups_rounds
from seqbin.operators.hubs import hub_stars, overlap_hubs, shared_occurrences, shared_windows
from seqbin.plans.binning import bin_indexed, find_groups
from seqbin.staging import stage


def pairs_of(hubs):
    members = defaultdict(set)
    for r in hubs.collect():
        members[r.hub].add(r.read_id)
    return {pair for reads in members.values() for pair in itertools.combinations(sorted(reads), 2)}


def genome_reads(seed, letters="ACGT"):
    """Reads of one or two runs from a short genome, with errors and low-complexity stretches."""
    rng = random.Random(seed)
    genome = "".join(rng.choice(letters) for _ in range(160)) + "A" * 20 + "ACAC" * 6
    reads = {}
    for i in range(70):
        runs = []
        for _ in range(rng.randrange(1, 3)):
            at, n = rng.randrange(len(genome) - 12), rng.randrange(4, 40)
            run = list(genome[at : at + n])
            if rng.random() < 0.6:
                run[rng.randrange(len(run))] = rng.choice(letters)
            runs.append("".join(run))
        reads[i] = [[run] for run in runs]
    return reads


@pytest.mark.parametrize("k,m,hot", [(8, 3, 4096), (8, 3, 6), (9, 1, 4096), (6, 4, 5), (12, 5, 4096)])
def test_hubs_are_the_overlap_graph(spark, k, m, hot):
    for reads in (skewed_reads(), genome_reads(k, "AC" if m == 4 else "ACGT")):
        want = {(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, k) for i, r in reads.items()}, m)}
        assert pairs_of(overlap_hubs(read_table(spark, reads).repartition(3), k, m, hot)) == want


def test_groups_equal_those_of_listed_pairs(spark):
    k, m = 8, 3
    for reads, cap in ((skewed_reads(), 4), (genome_reads(3), 1)):
        table = read_table(spark, reads)
        pairs = [(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, k) for i, r in reads.items()}, m)]
        edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
        hubs = stage(overlap_hubs(table, k, m), "hubs")
        components = stage(attach_components(table, connected_components(hub_stars(hubs))), "components")
        assert {r.read_id: r.component for r in components.collect()} == brute.components(pairs) | {
            i: i for i in reads if not any(i in pair for pair in pairs)
        }
        want = sorted(seed_groups_rounds(edges, components, cap).collect())
        assert sorted(seed_groups_hubs(hubs, components, cap).collect()) == want


def variants(count):
    """Copies of one read of two mates with one base changed in each."""
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(2)]
    reads = {}
    for i in range(count):
        mates = []
        for mate, at in zip(base, (i % 120, i // 120 % 120)):
            mates.append([mate[:at] + "ACGT"[("ACGT".index(mate[at]) + 1 + i // 14_400) % 4] + mate[at + 1 :]])
        reads[i] = mates
    return reads


def test_deep_coverage_is_linear(spark):
    k, m = 30, 5
    sizes = {}
    for count in (2_500, 20_000):
        hubs = stage(overlap_hubs(read_table(spark, variants(count)).repartition(4), k, m), "hubs")
        sizes[count] = hubs.filter("hub >= 0").count(), hubs.filter("hub < 0").count()
        parts = hubs.groupBy("hub", "part").count().agg(F.max("count")).first()[0]
        assert parts <= 4096
    # one row per window and read at most; of 200 million overlapping pairs only those without a common mark
    assert sizes[20_000][0] <= 20_000 * 2 * (120 - 33)
    assert sizes[20_000][1] < 1_000_000, sizes
    reads = spark.range(20_000).withColumnRenamed("id", "read_id")
    components = stage(attach_components(reads, connected_components(hub_stars(hubs))), "components")
    grouped = seed_groups_hubs(hubs, components, 20)
    first = reads.orderBy(F.xxhash64("read_id")).first().read_id
    summary = grouped.groupBy("group_id", "is_seed").agg(F.count("*").alias("n"), F.min("read_id").alias("low")).collect()
    assert sorted((r.group_id, r.is_seed, r.n) for r in summary) == [("0.0", False, 19_999), ("0.0", True, 1)]
    assert [r.low for r in summary if r.is_seed] == [first]


def test_windows_told_by_the_next_are_left_out(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(60))
    reads = {0: [[text[:50]]], 1: [[text[10:]]], 2: [[text[5:45]]]}
    hubs = shared_windows(shared_occurrences(read_table(spark, reads), 10, 4), 4)
    # the last window of the shorter read, and the last of the other shared stretch
    assert hubs.select("hub").distinct().count() == 2


def test_find_groups_by_hubs_and_by_pairs(spark):
    params = BinningParams(kmer_size=8, threshold=3, seed_max=3, hot_kmer_reads=8, discard=False)
    reads = skewed_reads() | {300 + i: skewed_reads()[0] for i in range(9)}
    table = stage(read_table(spark, reads).withColumn("label", F.lit("x")), "reads")
    by_hubs = sorted(find_groups(table, params).collect())
    run = bin_indexed(table, params)
    assert sorted(run.groups.collect()) == by_hubs
    firsts = {r.rep for r in run.copies.collect()}
    want = {(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, 8) for i, r in reads.items() if i in firsts}, 3)}
    assert {(r.src, r.dst) for r in run.edges.collect()} == want
    assert sorted(find_groups(table, params, listed=True).collect()) == by_hubs
