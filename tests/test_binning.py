import random

import brute
import pytest
from pyspark.sql import functions as F

from seqbin import BinningParams
from seqbin.operators import overlap
from seqbin.operators.cover import covered_components
from seqbin.operators.kmers import kmer_tokens
from seqbin.operators.overlap import hot_kmers
from seqbin.operators.records import merge_mates, parse_records, with_read_index
from seqbin.plans.binning import (
    bin_indexed,
    bin_reads,
    components_of_reads,
    find_groups,
    groups_from_edges,
    labels_from_vectors,
)
from seqbin.staging import stage, stage_scope

K, M = 8, 3


def skewed_reads() -> dict[int, list[list[str]]]:
    """A third near copies, a third with one common k-mer, the rest from one genome."""
    rng = random.Random(11)

    def text(n):
        return "".join(rng.choice("ACGT") for _ in range(n))

    base, adapter, genome = text(40), text(K), text(250)
    reads = {}
    for i in range(90):
        if i % 3 == 0:
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(40)] = rng.choice("ACGT")
            seq = "".join(copy)
        elif i % 3 == 1:
            seq = adapter + text(25)
        else:
            at = rng.randrange(len(genome) - 30)
            seq = genome[at : at + 30]
        reads[i] = [[seq]]
    # overlaps that no window of K + M - 1 bases shows: three separate k-mers
    reads[200] = [["T".join([base[0:8], base[12:20], base[24:32]])]]
    reads[201] = [["G".join([base[0:8], base[12:20], base[24:32]])]]
    # a read with repeated k-mers
    reads[202] = [["ACAC" * 6 + "A" * 12]]
    reads[203] = [["CACA" * 6 + "A" * 12]]
    return reads


def read_table(spark, reads):
    return spark.createDataFrame(list(reads.items()), "read_id bigint, mates array<array<string>>")


def test_cover_finds_the_components(spark):
    reads = skewed_reads()
    pairs = [(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, K) for i, r in reads.items()}, M)]
    want = {i: i for i in reads} | brute.components(pairs)
    table = read_table(spark, reads)
    assert not hot_kmers(kmer_tokens(table, K), 10).isEmpty()
    for limit in (10, 4096):
        components, _ = covered_components(table, K, M, hot_limit=limit)
        assert {r.read_id: r.component for r in components.collect()} == want
    params = BinningParams(kmer_size=K, threshold=M, hot_kmer_reads=10)
    assert {r.read_id: r.component for r in components_of_reads(table, params).collect()} == want


def test_one_grouping_at_every_limit_and_partitioning(spark, monkeypatch):
    reads = skewed_reads()
    reads |= {300 + i: reads[0] for i in range(25)} | {400 + i: [["ACGT"]] for i in range(3)}  # copies, and too short ones
    pairs = [(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, K) for i, r in reads.items()}, M)]
    around = brute.neighbor_sets(pairs)
    want = {i: i for i in reads} | brute.components(pairs)
    table = read_table(spark, reads)
    seen = []
    for limit, block, partitions in ((4096, 1024, 4), (10, 1024, 1), (10, 7, 13), (3, 16, 5)):
        monkeypatch.setattr(overlap, "BLOCK_ROWS", block)
        params = BinningParams(kmer_size=K, threshold=M, seed_max=4, hot_kmer_reads=limit)
        rows = find_groups(table.repartition(partitions), params).collect()
        brute.check_groups(rows, want, around, 4)
        seen.append(sorted(map(tuple, rows)))
    assert all(rows == seen[0] for rows in seen)
    # the first maximal independent set by hash, and the smallest adjacent seed
    rank = {r.read_id: r.h for r in table.select("read_id", F.xxhash64("read_id").alias("h")).collect()}
    first = {}
    for i in sorted(reads):
        first.setdefault(str(reads[i]), i)
    stands = {i: first[str(reads[i])] if around[i] else i for i in reads}
    seeds = set()
    for i in sorted(reads, key=lambda x: (rank[stands[x]], x)):
        if not around[i] & seeds:
            seeds.add(i)
    got = {r[3]: r for r in seen[0]}
    assert {i for i, r in got.items() if r[4]} == seeds
    for i in set(reads) - seeds:
        assert got[i][0] == got[min(around[i] & seeds)][0]


def test_greedy_is_a_choice(spark):
    reads = skewed_reads()
    pairs = [(a, b) for a, b, _ in brute.edges({i: brute.kmer_set(r, K) for i, r in reads.items()}, M)]
    want = {i: i for i in reads} | brute.components(pairs)
    params = BinningParams(kmer_size=K, threshold=M, seed_max=4, group_method="greedy")
    brute.check_groups(find_groups(read_table(spark, reads), params).collect(), want, brute.neighbor_sets(pairs), None)


def species_records(rng: random.Random) -> list[str]:
    """Reads of two genomes of very different composition."""
    out = []
    for name, weights in (("gc", (1, 6, 6, 1)), ("at", (6, 1, 1, 6))):
        genome = "".join(rng.choices("ACGT", weights, k=1500))
        for i in range(60):
            at = rng.randrange(1500 - 120)
            head = f"{name}{i}"
            out.append(f"{head}.1 |SOURCES={{GI={name},fw}}|\n{genome[at:at + 60]}")
            out.append(f"{head}.2 |SOURCES={{GI={name},bw}}|\n{genome[at + 60:at + 120]}")
    return out


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_end_to_end(spark, tmp_path, fmt):
    records = species_records(random.Random(3))
    path = tmp_path / "reads.fna"
    path.write_text("".join(f">{rec}\n" for rec in records))
    params = BinningParams(kmer_size=20, threshold=5, fmt=fmt)
    run = bin_reads(spark, str(path), params, work_dir=str(tmp_path / "work"))
    score = run.metrics().first()
    assert score.precision == 1.0 and score.recall > 0.8
    assert run.labels.count() == 120
    # a run resumes from its files and gives the same
    groups = groups_from_edges(run.reads, params, str(tmp_path / "work"))
    assert sorted(groups.collect()) == sorted(run.groups.collect())
    _, _, labels = labels_from_vectors(groups, run.reads, params, str(tmp_path / "work"))
    assert sorted(labels.collect()) == sorted(run.labels.collect())
    assert {r.stage: r.n for r in run.stats().collect()}["reads"] == 120
    run.write(str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out/binout"), lineSep="\r\n").collect()) == 120
    fasta = spark.read.text(str(tmp_path / "out/cluster"), lineSep="\r\n")
    text = "\n".join(sorted(r.value for r in fasta.collect()))
    assert sorted(text.split("\n")) == sorted(
        line if i else f">{line}" for rec in records for i, line in enumerate(rec.split("\n"))
    )
    if fmt == "parquet":
        other = spark.createDataFrame([(r,) for r in records], "rec string").repartition(13)
        again = bin_reads(spark, other, params)
        assert sorted(again.labels.collect()) == sorted(run.labels.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        try:
            again = bin_reads(spark, other, params)
            assert sorted(again.labels.collect()) == sorted(run.labels.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_read_in_several_rows_counts_once(spark, tmp_path):
    records = species_records(random.Random(4))
    records += [f"gc1.{i} |SOURCES={{GI=gc,fw}}|\n{'ACGTTGCA' * 6}{'ACGT'[i % 4] * 5}" for i in range(3, 12)]
    table = spark.createDataFrame([(r,) for r in records], "rec string")
    reads = stage(with_read_index(merge_mates(parse_records(table), max_mates=4)), "reads")
    assert reads.count() == 122
    run = bin_indexed(reads, BinningParams(kmer_size=20, threshold=5))
    assert run.labels.count() == 120
    run.write(str(tmp_path / "out"))
    assert len(spark.read.text(str(tmp_path / "out/binout"), lineSep="\r\n").collect()) == 120
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/info")).collect()]
    assert sum(int(line.split()[3]) for line in lines[1:]) == 120
    rows = run.results().filter("id = 'gc1'").orderBy("part").collect()
    assert len(rows) == 3 and [r.part for r in rows] == [0, 1, 2]
    flat = [line for r in rows for line in r.data.split("\n") if line.startswith(">")]
    assert flat == sorted(flat, key=lambda x: (not x.startswith(">gc1.1 "), x))  # (flag, raw) over all parts


def test_stage_scope_deletes_its_tables(spark):
    import os

    with stage_scope(spark):
        table = stage(spark.range(3), "scoped")
        path = table._stage_path
        assert table.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        BinningParams(fmt="csv")
    with pytest.raises(ValueError):
        BinningParams(kmer_size=0)
