"""The whole binning run, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbin.operators.clusters import cluster_groups, label_groups, label_reads
from seqbin.operators.copies import expand_components, expand_groups, read_copies
from seqbin.operators.graph import attach_components, connected_components
from seqbin.operators.groups import discard_small, group_reads, seed_groups_hubs
from seqbin.operators.hubs import can_cover, has_hot_kmers, hub_stars, overlap_hubs
from seqbin.operators.metrics import binning_metrics
from seqbin.operators.overlap import overlap_of_reads
from seqbin.operators.records import merge_mates, parse_records, with_read_index
from seqbin.operators.results import results
from seqbin.operators.stats import stage_stats
from seqbin.operators.vectors import frequency_vectors
from seqbin.params import BinningParams
from seqbin.plans.phases import EDGE_PARAMS, VECTOR_PARAMS, begin_phase, check_phase, end_phase, require_mark
from seqbin.sinks.results import write_cluster_fasta, write_labels, write_summary
from seqbin.sinks.tables import write_edges, write_vectors
from seqbin.sources.fasta import read_fasta
from seqbin.sources.tables import read_edges, read_vectors
from seqbin.staging import stage


@dataclass(frozen=True)
class Binning:
    """Tables of a finished run. Labels and everything before them are stage tables."""

    params: BinningParams
    reads: DataFrame
    groups: DataFrame
    vectors: DataFrame
    clusters: DataFrame
    labels: DataFrame
    copies: DataFrame
    listed: DataFrame | None = None

    @cached_property
    def edges(self) -> DataFrame:
        """``(src, dst)``: all pairs of different overlapping reads, listed when first asked for."""
        return self.listed if self.listed is not None else overlap_pairs(self.reads, self.copies, self.params)

    def stats(self) -> DataFrame:
        """``(stage, n)``: reads, edges between different reads, and copies left out of them."""
        extra = self.copies.filter("read_id <> rep").agg(F.count("*").alias("n"))
        return stage_stats(self.reads, edges=self.edges).unionByName(extra.select(F.lit("copies").alias("stage"), "n"))

    def metrics(self, convention: str = "label_max") -> DataFrame:
        return binning_metrics(self.labels, self.params.discard, convention)

    def results(self) -> DataFrame:
        return results(self.reads, self.labels)

    def write(self, out_dir: str) -> None:
        """Label list, FASTA per cluster and summary below ``out_dir``."""
        rows = stage(self.results(), "results")
        write_labels(rows, f"{out_dir}/binout")
        write_cluster_fasta(rows, f"{out_dir}/cluster")
        write_summary(rows, f"{out_dir}/info", self.params.num_species)


def index_records(records: DataFrame) -> DataFrame:
    """Records -> indexed reads, as a stage table."""
    merged = stage(merge_mates(parse_records(records)), "merged")  # parse the text once
    return stage(with_read_index(merged), "reads")


def find_copies(reads: DataFrame, params: BinningParams) -> DataFrame:
    """``(read_id, rep)``: who stands for whom."""
    return stage(read_copies(reads, params.kmer_size, params.threshold), "copies")


def _different(reads: DataFrame, copies: DataFrame) -> DataFrame:
    first = copies.filter("read_id = rep").select("read_id")
    return stage(reads.join(first, "read_id", "left_semi"), "different-reads")


def overlap_pairs(reads: DataFrame, copies: DataFrame, params: BinningParams) -> DataFrame:
    """``(src, dst)``: all pairs of different reads that overlap, however hot their k-mers are."""
    different = _different(reads, copies)
    edges = overlap_of_reads(different, params.kmer_size, params.threshold, params.hot_kmer_reads)
    return stage(edges.select("src", "dst"), "edges")


def find_overlaps(reads: DataFrame, params: BinningParams) -> tuple[DataFrame, DataFrame]:
    """``(edges, copies)``: overlaps between different reads, and who stands for whom."""
    copies = find_copies(reads, params)
    return overlap_pairs(reads, copies, params), copies


def groups_from_overlaps(edges: DataFrame, copies: DataFrame, params: BinningParams) -> DataFrame:
    """Seed groups of all reads from :func:`find_overlaps`.

    One rule at every size: it depends on the overlaps and the parameters only.
    Copies join the group of the read that stands for them.
    """
    first = copies.filter("read_id = rep").select("read_id")
    components = stage(attach_components(first, connected_components(edges)), "components")
    groups = group_reads(edges, components, params.seed_max, params.group_method, params.strict_seed_cap)
    return expand_groups(groups, copies)


def groups_from_hubs(hubs: DataFrame, copies: DataFrame, params: BinningParams) -> DataFrame:
    """The groups of :func:`groups_from_overlaps`, from shared windows instead of listed pairs."""
    first = copies.filter("read_id = rep").select("read_id")
    components = stage(attach_components(first, connected_components(hub_stars(hubs))), "components")
    return expand_groups(seed_groups_hubs(hubs, components, params.seed_max), copies)


def components_of_reads(reads: DataFrame, params: BinningParams) -> DataFrame:
    """``(read_id, component)`` of every read, by pairs of different reads and their copies."""
    edges, copies = find_overlaps(reads, params)
    first = copies.filter("read_id = rep").select("read_id")
    return expand_components(attach_components(first, connected_components(edges)), copies)


def find_groups(reads: DataFrame, params: BinningParams, listed: bool = False) -> DataFrame:
    """Seed groups of all reads; ``listed`` makes them from the table of all pairs.

    The groups are the same. Pairs are also listed where they are needed (to grow groups
    one after another, and for k-mers too long to pack) and where they are few: without
    hot k-mers the pairs of a read are bounded. With hot k-mers they would grow with the
    square of the reads, and shared windows stand for them.
    """
    copies = find_copies(reads, params)
    return _groups(reads, copies, None if not listed else overlap_pairs(reads, copies, params), params)


def _groups(reads: DataFrame, copies: DataFrame, edges: DataFrame | None, params: BinningParams) -> DataFrame:
    if edges is not None:
        return groups_from_overlaps(edges, copies, params)
    different = _different(reads, copies)
    size = params.kmer_size, params.threshold, params.hot_kmer_reads
    if params.group_method == "stars" and can_cover(*size[:2]) and has_hot_kmers(different, size[0], size[2]):
        return groups_from_hubs(stage(overlap_hubs(different, *size), "hubs"), copies, params)
    edges = stage(overlap_of_reads(different, *size).select("src", "dst"), "edges")
    return groups_from_overlaps(edges, copies, params)


def bin_reads(
    spark: SparkSession,
    source: str | DataFrame,
    params: BinningParams | None = None,
    work_dir: str | None = None,
) -> Binning:
    """Bin the reads of a FASTA path or of a ``(rec)`` table.

    With ``work_dir`` the edges, the copies and the group vectors are also kept
    there, in ``params.fmt`` (copies as parquet), and read back for the next phase;
    see :func:`groups_from_edges` and :func:`labels_from_vectors`. Without it pairs are
    listed only where they are few (see :func:`find_groups`) or when ``edges`` is asked for.
    """
    params = params or BinningParams()
    records = read_fasta(spark, source) if isinstance(source, str) else source
    reads = index_records(records)
    return bin_indexed(reads, params, work_dir)


def bin_indexed(
    reads: DataFrame, params: BinningParams, work_dir: str | None = None
) -> Binning:
    """:func:`bin_reads` from indexed reads."""
    copies = find_copies(reads, params)
    edges = None
    if work_dir is not None:
        spark = reads.sparkSession
        edges = overlap_pairs(reads, copies, params)
        for phase in ("edges", "vectors"):
            begin_phase(spark, work_dir, phase)
        write_edges(edges, f"{work_dir}/edges", params.fmt)
        copies.write.mode("overwrite").parquet(f"{work_dir}/copies")
        end_phase(reads, params, EDGE_PARAMS, work_dir, "edges", _edge_files(spark, params, work_dir))
        groups = groups_from_edges(reads, params, work_dir)
    else:
        groups = _kept_groups(_groups(reads, copies, edges, params), params)
    vectors = stage(frequency_vectors(groups, reads, params.profile_k), "vectors")
    if work_dir is not None:
        write_vectors(vectors, f"{work_dir}/vectors", params.fmt)
        end_phase(reads, params, VECTOR_PARAMS, work_dir, "vectors", _vector_files(spark, params, work_dir))
        vectors, clusters, labels = labels_from_vectors(groups, reads, params, work_dir)
    else:
        clusters, labels = _labels(vectors, groups, reads, params)
    return Binning(params, reads, groups, vectors, clusters, labels, copies, edges)


def _edge_files(spark: SparkSession, params: BinningParams, work_dir: str) -> dict[str, DataFrame]:
    return {
        "edges": read_edges(spark, f"{work_dir}/edges", params.fmt),
        "copies": spark.read.schema("read_id long, rep long").parquet(f"{work_dir}/copies"),
    }


def _vector_files(spark: SparkSession, params: BinningParams, work_dir: str) -> dict[str, DataFrame]:
    return {"vectors": read_vectors(spark, f"{work_dir}/vectors", params.fmt)}


def groups_from_edges(reads: DataFrame, params: BinningParams, work_dir: str) -> DataFrame:
    """Groups of a run from the edge and copy files in its ``work_dir``.

    Files that are incomplete, or of other reads or parameters, are a ``ValueError``.
    """
    require_mark(reads.sparkSession, work_dir, "edges")
    files = _edge_files(reads.sparkSession, params, work_dir)
    check_phase(reads, params, EDGE_PARAMS, work_dir, "edges", files)
    return _kept_groups(groups_from_overlaps(files["edges"], files["copies"], params), params)


def labels_from_vectors(
    groups: DataFrame, reads: DataFrame, params: BinningParams, work_dir: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(vectors, clusters, labels)`` of a run from the vector file in its ``work_dir``.

    A file that is incomplete, or of other reads or parameters, is a ``ValueError``.
    """
    require_mark(reads.sparkSession, work_dir, "vectors")
    files = _vector_files(reads.sparkSession, params, work_dir)
    check_phase(reads, params, VECTOR_PARAMS, work_dir, "vectors", files)
    vectors = files["vectors"].withColumn("features", F.when(F.size("features") > 0, F.col("features")))
    return vectors, *_labels(vectors, groups, reads, params)


def _kept_groups(groups: DataFrame, params: BinningParams) -> DataFrame:
    if params.discard:
        groups = discard_small(stage(groups, "all-groups"), params.min_group_size)
    return stage(groups, "groups")


def _labels(
    vectors: DataFrame, groups: DataFrame, reads: DataFrame, params: BinningParams
) -> tuple[DataFrame, DataFrame]:
    clusters = stage(
        cluster_groups(vectors, params.num_species, params.kmeans_max_iter, params.kmeans_seed), "clusters"
    )
    return clusters, stage(label_reads(reads, label_groups(groups, clusters)), "labels")
