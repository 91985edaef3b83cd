import glob

import pytest
from pyspark.sql import functions as F

from seqbin.operators.clusters import cluster_groups, label_groups, label_reads
from seqbin.operators.metrics import (
    binning_metrics,
    confusion_matrix,
    label_values,
    metrics_from_matrix,
)
from seqbin.operators.results import cluster_summary, in_result_order, results
from seqbin.operators.stats import stage_stats
from seqbin.operators.vectors import frequency_vectors
from seqbin.plans import registry
from seqbin.sinks.results import write_cluster_fasta, write_labels, write_summary
from seqbin.sinks.tables import write_edges, write_kmer_index, write_vectors
from seqbin.sources.tables import read_edges, read_kmer_index, read_vectors

LABELS = [("A", 0)] * 3 + [("A", 1)] + [("B", 0)] * 2 + [("A", -1)]


def label_table(spark, pairs=LABELS):
    rows = [(i, label, predict) for i, (label, predict) in enumerate(pairs)]
    return spark.createDataFrame(rows, "read_id bigint, label string, predict int")


@pytest.mark.parametrize(
    "discard,convention,precision,recall",
    [
        (True, "label_max", 5 / 6, 4 / 7),
        (True, "cluster_max", 4 / 6, 5 / 7),
        (False, "label_max", 5 / 7, 5 / 7),
        (False, "cluster_max", 5 / 7, 5 / 7),
    ],
)
def test_metrics(spark, discard, convention, precision, recall):
    labels = label_table(spark)
    want = (precision, recall, 2 / (1 / precision + 1 / recall))
    assert tuple(binning_metrics(labels, discard, convention).first()) == pytest.approx(want)
    matrix = confusion_matrix(labels, ["A", "B"])
    assert tuple(metrics_from_matrix(matrix, discard, convention).first()) == pytest.approx(want)


def test_metrics_without_assigned_reads(spark):
    labels = label_table(spark, [("A", -1), ("A", -1)])
    for row in (binning_metrics(labels).first(), metrics_from_matrix(confusion_matrix(labels, ["A"])).first()):
        assert row.precision is None and row.f_measure is None and row.recall == 0.0
    empty = metrics_from_matrix(labels.select("predict")).first()
    assert tuple(empty) == (None, None, None)
    with pytest.raises(ValueError):
        binning_metrics(labels, convention="other")


GROUPS = "group_id string, component bigint, group_idx int, read_id bigint, is_seed boolean"


def test_vectors(spark):
    groups = spark.createDataFrame(
        [("p", 0, 0, 1, True), ("p", 0, 0, 2, False), ("none", 3, 0, 3, True), ("q", 4, 0, 4, True)], GROUPS
    )
    reads = spark.createDataFrame(
        [(1, [["AATT"]]), (2, [["GGGG"]]), (3, [["AC", "GT"]]), (4, [["AAAAC"], ["TTTT"]])],
        "read_id bigint, mates array<array<string>>",
    )
    rows = {r.group_id: r.features for r in frequency_vectors(groups, reads).collect()}
    assert rows["none"] is None
    assert len(rows["p"]) == 136 and sorted(rows["p"])[-2:] == [0.0, 2.0]  # a palindrome counts twice
    assert rows["q"][0] == pytest.approx(2 / 3) and rows["q"][1] == pytest.approx(1 / 3)


def test_clusters_and_labels(spark):
    near = [(f"g{i}", [float(i % 2) * 9 + i / 100] * 4) for i in range(20)] + [("none", None)]
    vectors = spark.createDataFrame(near, "group_id string, features array<double>")
    runs = [
        {r.group_id: r.prediction for r in cluster_groups(vectors.repartition(n), 2).collect()} for n in (1, 4, 13)
    ]
    assert runs[0] == runs[1] == runs[2] and runs[0]["none"] == -1
    assert len({runs[0][f"g{i}"] for i in range(0, 20, 2)}) == 1 and runs[0]["g0"] != runs[0]["g1"]
    groups = spark.createDataFrame([("g0", 1), ("g0", 2), ("gx", 3)], "group_id string, read_id bigint")
    clusters = spark.createDataFrame([("g0", 5)], "group_id string, prediction int")
    reads = spark.createDataFrame([(i, "s") for i in range(1, 5)], "read_id bigint, label string")
    labels = label_reads(reads, label_groups(groups, clusters)).collect()
    assert {r.read_id: r.predict for r in labels} == {1: 5, 2: 5, 3: -1, 4: -1}


def test_results_and_sinks(spark, tmp_path):
    reads = spark.createDataFrame(
        [(i, f"r{i}", "s", [f"h{i}\nAC", f"k{i}\nGT"]) for i in (10, 2, 1, 30)],
        "read_id bigint, id string, label string, raws array<string>",
    )
    labels = spark.createDataFrame([(10, 1), (2, 0), (1, -1)], "read_id bigint, predict int")
    rows = in_result_order(results(reads, labels)).collect()
    assert [(r.id, r.predict) for r in rows] == [("r1", -1), ("r2", 0), ("r10", 1)]
    assert rows[0].data == ">h1\nAC\n>k1\nGT"
    assert results(reads, labels, how="left").filter("predict is null").count() == 1
    df = results(reads, labels)
    assert [tuple(r) for r in cluster_summary(df).collect()] == [(-1, 1), (0, 1), (1, 1)]

    def content(folder):
        files = sorted(glob.glob(f"{folder}/part-*"))
        return b"".join(open(f, "rb").read() for f in files)

    for single in (True, False):
        write_labels(df, str(tmp_path / "binout"), single_file=single)
        assert content(tmp_path / "binout") == b"-1\r\n0\r\n1\r\n"
    write_cluster_fasta(df, str(tmp_path / "cluster"))
    assert content(tmp_path / "cluster" / "cluster=1") == b">h10\nAC\n>k10\nGT\r\n"
    write_summary(df, str(tmp_path / "info"), 2)
    assert content(tmp_path / "info") == (
        b"Number of cluster: 2\nCluster -1 : 1 reads\nCluster 0 : 1 reads\nCluster 1 : 1 reads\n"
    )


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_table_round_trips(spark, tmp_path, fmt):
    edges = spark.createDataFrame([(1, 2, 7), (3, 4, 9)], "src bigint, dst bigint, weight bigint")
    write_edges(edges, str(tmp_path / "e"), fmt)
    assert {tuple(r) for r in read_edges(spark, str(tmp_path / "e"), fmt).collect()} == {(1, 2), (3, 4)}
    index = spark.createDataFrame([("ACG", [1, 2, 3]), ("TTT", [9, 10])], "kmer string, adjacency array<bigint>")
    write_kmer_index(index, str(tmp_path / "k"), fmt)
    assert sorted(read_kmer_index(spark, str(tmp_path / "k"), fmt).collect()) == sorted(index.collect())
    vectors = spark.createDataFrame(
        [("0.1", [0.1, 1 / 3, 1e-17]), ("0.2", [0.0, 2.0, 3.0])], "group_id string, features array<double>"
    )
    write_vectors(vectors, str(tmp_path / "v"), fmt)
    assert sorted(read_vectors(spark, str(tmp_path / "v"), fmt).collect()) == sorted(vectors.collect())
    with pytest.raises(ValueError):
        read_edges(spark, str(tmp_path / "e"), "csv")


def test_stage_stats(spark):
    reads = spark.range(3).withColumnRenamed("id", "read_id")
    index = spark.createDataFrame([("A", [1]), ("A", [2]), ("C", [1])], "kmer string, adjacency array<bigint>")
    rows = {r.stage: r.n for r in stage_stats(reads, index, reads, reads).collect()}
    assert rows == {"reads": 3, "kmers": 2, "vertices": 3, "edges": 3}


@pytest.mark.parametrize("name", ["confusion_matrix", "binning_metrics_matrix_cluster_max_all"])
def test_queries_count_every_label(spark, monkeypatch, name):
    rows = [("src0", 0), ("src0", 1), ("src20", 0), ("src20", 0), ("new.one", 1), ("null", 1), (None, 1), (None, 2), ("SRC", -1)]
    labels = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_id long, label string, predict int")
    monkeypatch.setattr(registry, "_labels", lambda spark, sf_dir: labels)
    got = registry.QUERIES[name](spark, "")
    if name == "confusion_matrix":
        assert got.columns == ["predict", *(f"src{i}" for i in range(20)), "SRC", "new.one", "null", "src20", "null_"]
        assert sum(sum(r[1:]) for r in got.collect()) == len(rows)
        assert {r["predict"]: r["null_"] for r in got.collect()} == {-1: 0, 0: 0, 1: 1, 2: 1}
    else:
        want = binning_metrics(labels, False, "cluster_max").first()
        assert tuple(got.first()) == tuple(round(x, 9) for x in want)


def test_too_many_labels_are_an_error(spark):
    labels = spark.createDataFrame([(i, f"l{i}", 0) for i in range(5)], "read_id long, label string, predict int")
    assert label_values(labels, most=5) == [f"l{i}" for i in range(5)]
    with pytest.raises(ValueError, match="more than 4 labels"):
        label_values(labels, most=4)
