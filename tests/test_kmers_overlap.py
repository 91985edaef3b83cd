import random

import brute
import pytest
from pyspark.sql import functions as F

from seqbin.functions import dna
from seqbin.functions.vocabulary import canonical_kmers, canonical_size
from seqbin.operators.kmers import kmer_index, kmer_tokens, read_kmers
from seqbin.operators.overlap import index_pairs, overlap_edges, overlap_of_reads

READ_SCHEMA = "read_id bigint, mates array<array<string>>"


def random_reads(seed: int, n: int = 60) -> dict[int, list[list[str]]]:
    """Reads cut from one genome, with errors, N splits, copies and repeats."""
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(300)) + "A" * 20 + "ACAC" * 6
    reads = {}
    for i in range(n):
        mates = []
        for _ in range(2):
            at = rng.randrange(len(genome) - 40)
            text = list(genome[at : at + 40])
            if rng.random() < 0.5:
                text[rng.randrange(40)] = rng.choice("ACGTN")
            mates.append([run for run in "".join(text).split("N") if run])
        reads[i] = mates
    reads[n] = reads[0]
    return reads


def read_table(spark, reads):
    return spark.createDataFrame(list(reads.items()), READ_SCHEMA)


def as_set(edges):
    return {(r.src, r.dst, r.weight) for r in edges.collect()}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACgtNxxACN",), ("NN",), ("",), ("AATT",)], "s string")
    row = df.select(
        dna.clean_runs("s").alias("runs"), dna.revcomp("s").alias("rc"), dna.kmers_of("s", 4).alias("k")
    ).collect()
    assert [r.runs for r in row] == [["ACGT", "AC"], [], [], ["AATT"]]
    assert row[3].rc == "AATT" and row[3].k == ["AATT"] and row[2].k == [] and row[1].k == []
    v = spark.createDataFrame([([0.0, 2.0, 0.0, 1.5, 0.0],), ([0.0] * 5,)], "v array<double>")
    back = v.select("v", dna.to_dense(dna.to_sparse("v"), 5).alias("w"), dna.round_scale(F.lit(2.5), -1).alias("big"))
    assert all(r.v == r.w and r.big == 1.7976931348623157e308 for r in back.collect())


def test_vocabulary(spark):
    rows = canonical_kmers(spark, 4).orderBy("idx").collect()
    assert len(rows) == canonical_size(4) == 136
    assert [r.idx for r in rows] == list(range(136))
    assert [r.kmer for r in rows] == sorted(r.kmer for r in rows)
    assert rows[0].kmer == "AAAA" and canonical_size(3) == 32


def test_kmers_are_sets_and_never_cross_n(spark):
    reads = {1: [["ACG"]], 2: [["ACGT"]], 3: [["ACGTACGTA"], ["ACGT"]], 4: [[], ["AC", "GTAC"]]}
    rows = {(r.read_id, r.kmer) for r in read_kmers(read_table(spark, reads), 4).collect()}
    assert rows == {(i, k) for i, mates in reads.items() for k in brute.kmer_set(mates, 4)}


@pytest.mark.parametrize("k", [5, 12])
def test_packed_tokens_match_text(spark, k):
    table = read_table(spark, random_reads(1))
    packed = {(r.read_id, r.kmer) for r in kmer_tokens(table, k).collect()}
    text = read_kmers(table, k).select("read_id", dna.kmer_key("kmer").alias("kmer"))
    assert packed == {(r.read_id, r.kmer) for r in text.collect()}
    with pytest.raises(ValueError):
        kmer_tokens(table, 32)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("m", [1, 4])
def test_edges_against_brute_force(spark, seed, m):
    reads, k = random_reads(seed), 6
    table = read_table(spark, reads)
    want = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, m)
    assert as_set(overlap_of_reads(table, k, m)) == want
    for hot_limit in (3, 8):  # most k-mers hot, some k-mers hot
        assert as_set(overlap_edges(kmer_tokens(table, k), m, hot_limit=hot_limit)) == want
        assert as_set(overlap_edges(read_kmers(table, k), m, hot_limit=hot_limit)) == want


def test_hot_kmers_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("seqbin.operators.overlap.BLOCK_ROWS", 7)
    reads, k = random_reads(3), 6
    want = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, 2)
    assert as_set(overlap_edges(kmer_tokens(read_table(spark, reads), k), 2, hot_limit=4)) == want


def test_edges_within_and_across(spark):
    reads, k, m = random_reads(4), 6, 2
    want = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, m)
    side = F.col("read_id") % 3
    table = read_table(spark, reads).withColumn("side", side)
    within = overlap_of_reads(table, k, m, within="side")
    assert as_set(within) == {e for e in want if e[0] % 3 == e[1] % 3}
    tokens = kmer_tokens(table, k).withColumn("side", side)
    across = {e for e in want if e[0] % 3 != e[1] % 3}
    for hot_limit in (4, 4096):
        assert as_set(overlap_edges(tokens, m, hot_limit=hot_limit, across="side")) == across


def test_long_kmers_stay_text(spark):
    reads = {i: mates for i, mates in random_reads(5).items()}
    want = brute.edges({i: brute.kmer_set(mates, 33) for i, mates in reads.items()}, 1)
    assert as_set(overlap_of_reads(read_table(spark, reads), 33, 1)) == want


@pytest.mark.parametrize("max_list", [4096, 5])
def test_index_pairs_equal_the_join(spark, max_list):
    reads, k, m = random_reads(6), 6, 3
    table = read_table(spark, reads)
    index = kmer_index(read_kmers(table, k), max_list=max_list)
    lists = index.collect()
    if max_list == 5:
        assert any(r.parts > 1 for r in lists)
    for rows in (index, index.select("kmer", "adjacency")):
        pairs = index_pairs(rows).groupBy("src", "dst").agg(F.count("*").alias("weight"))
        assert as_set(pairs.filter(F.col("weight") >= m)) == as_set(overlap_of_reads(table, k, m))
