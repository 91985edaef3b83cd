"""k-mers that are shuffled as pieces of runs arrive whole, and in few bytes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_kmers_overlap import random_reads, read_table

from seqbin.operators import cover, kmers, linked, pieces


def chunks_of(rows, k, **kind):
    """The rows of several batches, sorted by bucket and cut anew."""
    table = pa.Table.from_batches(rows).sort_by("bucket")
    return list(pieces.piece_chunks(iter(table.to_batches(max_chunksize=7)), k, **kind))


def random_runs(seed, lengths):
    base = np.random.default_rng(seed).integers(0, 4, sum(lengths))
    run_of = np.repeat(np.arange(len(lengths)), lengths)
    return base, run_of


@pytest.mark.parametrize("k", [1, 2, 5, 12, 29, 30, 31])
@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_every_kmer_arrives_once(monkeypatch, k, limit):
    monkeypatch.setattr(pieces, "CHUNK_ROWS", limit)
    monkeypatch.setattr(pieces, "PART_ROWS", 4 * limit)
    rows, want = [], []
    for seed, lengths in enumerate([[400, 31, 90], [31], [200, 200], [35] * 6]):
        base, run_of = random_runs(seed, lengths)
        base[50:130] = 2  # one minimizer for longer than a piece
        run_end = np.cumsum(lengths)[run_of]
        at = np.flatnonzero(np.arange(len(base)) + k <= run_end)
        at = at[at % 37 != 5]  # some were left out
        ids = (run_of - 2) * 10**12 + seed
        rows.append(pieces.deal_pieces(base, at, run_of[at], k, [ids[at], -at], np.full(len(at), 36)))
        key = pieces.joined_bases(base, k)[at]
        want += zip(key.tolist(), ids[at].tolist(), at.tolist())
    got, where = [], {}
    for chunk in chunks_of(rows, k, wide=2, ends=True):
        key = chunk.bases(0, k)
        assert chunk.place.max() < pieces._PIECE_KMERS and (chunk.ends == 36).all()
        got += zip(key.tolist(), chunk.wide[0][chunk.of].tolist(), (chunk.place - chunk.wide[1][chunk.of]).tolist())
        for one in set(key.tolist()):
            assert where.setdefault(one, chunk.number) == chunk.number  # all places of a k-mer are in one chunk
    assert sorted(got) == sorted(want)
    assert len(set(where.values())) > 1 or limit > 10


def test_no_kmers():
    none = np.zeros(0, np.int64)
    batch = pieces.deal_pieces(np.arange(4), none, none, 3, [none], none)
    assert batch.num_rows == 0 and not list(pieces.piece_chunks(iter([batch]), 3, wide=1, ends=True))


def test_dealt_tokens_are_the_tokens(spark):
    reads, k = read_table(spark, random_reads(21)), 6
    split = reads.withColumn("parts", F.when(F.col("read_id") % 3 == 0, 2).otherwise(1))
    for table in (reads, split):
        got = []
        for chunk in chunks_of(linked._dealt_tokens(table, k).toArrow().to_batches(), k, wide=2, ends=True):
            kmer, read, link = linked._token_columns(chunk, k)
            got += zip(read.tolist(), kmer.tolist(), link.tolist())
        assert sorted(got) == sorted(map(tuple, kmers.kmer_tokens(table, k).select("read_id", "kmer", "link").collect()))


def test_a_kmer_costs_about_two_bytes(spark):
    """Rows of ids and links took 16 to 32 bytes for each."""
    text = "".join(np.random.default_rng(5).choice(list("ACGT"), 40_000))
    reads = [(i, [[text[i * 400 : i * 400 + 400]]]) for i in range(100)]
    table = spark.createDataFrame(reads, "read_id bigint, mates array<array<string>>").coalesce(1)
    for dealt in (linked._dealt_tokens(table, 30), cover.dealt_windows(table, 30, 5)):
        row = dealt.agg(F.sum("kmers").alias("n"), F.sum(F.length("bases") + F.length("heads")).alias("bytes")).first()
        assert row.n >= 36_000 and row.bytes < 4 * row.n


def test_crossing_kmers(spark):
    reads, k = random_reads(22), 6
    table = read_table(spark, reads)
    twice = table.unionByName(table.filter("read_id in (2, 3)"))
    placed = twice.withColumn("piece", F.col("read_id") % 4)
    tokens = kmers.kmer_tokens(placed, k, carry="piece")
    spread = tokens.groupBy("kmer").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.count("*").alias("n_est")).filter("lo < hi")
    want = tokens.join(spread, "kmer").select("read_id", "kmer", "piece", "n_est")
    want = sorted(map(tuple, want.collect()))
    assert want and sorted(map(tuple, cover.crossing_kmers(placed, k).collect())) == want


def test_windows_of_equal_number_are_told_apart():
    one = np.uint64(0xD6E8FEB86659FD93).astype(np.int64)
    rows = cover._star_batch(np.array([0, 1, 0, 1]), np.array([one, 0, one, 5]), np.array([5, 1, 3, 2])).to_pydict()
    assert rows == {"src": [3], "dst": [5]}
