"""Pairs of reads from an index with run links."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqbin.operators import linked
from seqbin.operators.kmers import kmer_index, kmer_tokens, read_kmers
from seqbin.operators.linked import linked_index, linked_pairs
from seqbin.operators.overlap import index_pairs, overlap_edges, overlap_of_reads
from test_kmers_overlap import READ_SCHEMA, as_set, random_reads, read_table


@pytest.mark.parametrize("hot_limit", [2, 9, 4096])
def test_pairs_against_brute_force(spark, hot_limit):
    reads, k, m = random_reads(11), 6, 3
    want = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, m)
    assert as_set(linked_pairs(linked_index(read_table(spark, reads), k, hot_limit), m)) == want


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_blocks_of_a_hot_kmer_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(linked, "BLOCK_ROWS", block)
    monkeypatch.setattr(linked, "ENTRY_PAIRS", 40)
    reads, k, m = random_reads(12), 6, 1
    rows = kmer_tokens(read_table(spark, reads), k).collect()
    columns = [np.array([r[name] for r in rows]) for name in ("kmer", "read_id", "link")]
    weight = Counter()
    for batch in linked._entries(0, columns, hot_limit=5):
        for row in batch.to_pylist():
            for src, dst, delta in linked.run_ends(*(np.array(row[c]) for c in ("kmers", "reads", "links")), row["cut"]):
                for pair in zip(src.tolist(), dst.tolist(), delta.tolist()):
                    weight[pair[:2]] += pair[2]
    want = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, m)
    assert {(*pair, n) for pair, n in weight.items()} == want


def test_inside_of_a_common_text_costs_nothing(spark):
    """200 reads of one text: 19,900 pairs, told by the first and the last k-mer and not by all 71."""
    text = "".join(np.random.default_rng(3).choice(list("ACGT"), 100))
    table = spark.range(200).selectExpr("id as read_id", f"array(array('{text}')) as mates")
    index = linked_index(table, 30)
    assert index.select(F.explode("kmers")).distinct().count() == 2
    pairs = overlap_of_reads(table, 30, 5)
    assert pairs.agg(F.count("*"), F.min("weight"), F.max("weight")).first()[:] == (19_900, 71, 71)


def test_repeated_and_missing_ids_and_split_reads(spark):
    reads, k, m = random_reads(13, n=20), 6, 2
    rows = [(i, mates) for i, mates in reads.items()]
    table = spark.createDataFrame(rows + rows[:7] + [(3, rows[9][1]), (None, rows[0][1])], READ_SCHEMA)
    index = kmer_index(read_kmers(table.filter("read_id is not null"), k))
    want = index_pairs(index).groupBy("src", "dst").agg(F.count("*").alias("weight")).filter(F.col("weight") >= m)
    assert as_set(linked_pairs(linked_index(table, k), m, repeated=True)) == as_set(want)
    assert as_set(overlap_of_reads(table, k, m)) == as_set(want.filter("src <> dst"))
    for hot_limit in (4, 4096):  # as the join has them, ignored hot k-mers included
        known = table.filter("read_id is not null")
        assert as_set(overlap_of_reads(table, k, m, hot_limit)) == as_set(overlap_edges(kmer_tokens(known, k), m, hot_limit=hot_limit))

    # a read in several rows is one set of k-mers
    parts = [(i, [mate], 2) for i, mates in reads.items() for mate in mates]
    split = spark.createDataFrame(parts, f"{READ_SCHEMA}, parts int")
    whole = brute.edges({i: brute.kmer_set(mates, k) for i, mates in reads.items()}, m)
    assert as_set(overlap_of_reads(split, k, m)) == whole
    assert overlap_of_reads(table.limit(0), k, m).isEmpty()
