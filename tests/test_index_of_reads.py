"""The k-mer index from buckets is the index of listed k-mers, hot ones included."""

import pytest
from test_binning import read_table, skewed_reads
from test_hubs import genome_reads

from seqbin.operators import kmers


@pytest.mark.parametrize("limit", [1 << 20, 6])
def test_index_of_reads_is_the_index(spark, monkeypatch, limit):
    monkeypatch.setattr(kmers, "BUCKET_READS", limit)
    for reads in (skewed_reads(), genome_reads(3)):
        table = read_table(spark, reads)
        # a read that comes twice, and reads without an id
        table = table.unionByName(table.filter("read_id = 3")).unionByName(
            table.filter("read_id in (5, 6)").selectExpr("cast(null as bigint) as read_id", "mates")
        )
        want = kmers.kmer_index(kmers.read_kmers(table, 8), max_list=5)
        assert sorted(kmers.kmer_index_of_reads(table, 8, max_list=5).collect()) == sorted(want.select("kmer", "part", "parts", "adjacency").collect())


def test_single_kmers_are_not_sorted_by_range(spark):
    index = kmers.kmer_index_of_reads(read_table(spark, genome_reads(1)), 8)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
