"""Overlap graph: vertices, neighbours, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.operators.kmers import BUCKET_SCHEMA, bucket_chunks, deal_to_buckets
from seqbin.operators.skew import join_one
from seqbin.staging import release, stage

#: edges that are dealt to buckets at a time
_EDGE_ROWS = 1_000_000


def both_directions(edges: DataFrame) -> DataFrame:
    """``(read_id, nbr)``: every edge seen from both of its ends."""
    ends = F.array(
        F.struct(F.col("src").alias("read_id"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("read_id"), F.col("src").alias("nbr")),
    )
    return edges.select(F.inline(ends))


def vertices(edges: DataFrame, reads: DataFrame | None = None, drop_isolated: bool = True) -> DataFrame:
    """``(read_id)`` with at least one edge, or all of ``reads`` as well."""
    linked = both_directions(edges).select("read_id").distinct()
    if drop_isolated:
        return linked
    if reads is None:
        raise ValueError("reads are needed to keep isolated vertices")
    return linked.unionByName(reads.select("read_id")).distinct()


def neighbors(edges: DataFrame, max_list: int = 100_000) -> DataFrame:
    """``(read_id, part, parts, nbrs)``: sorted neighbour ids.

    A list longer than ``max_list`` is held in ``parts`` rows, so a hub is never
    gathered into one array of a row; ``parts`` is 1 for all other reads. Ends of edges are
    shuffled once, as lists by bucket of the read; the neighbours of a read are put in order in
    one task, at 16 bytes each.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batched(batches):
            src, dst = (np.concatenate(c) for c in zip(*held))
            yield deal_to_buckets([np.append(src, dst), np.append(dst, src)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (read, nbr) in bucket_chunks(batches):
            yield _neighbor_lists(read, nbr, max_list)

    ends = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).filter("src <> dst")
    dealt = ends.mapInArrow(deal, BUCKET_SCHEMA).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "read_id bigint, part int, parts int, nbrs array<bigint>")


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """The columns of batches, about ``_EDGE_ROWS`` rows together."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            # a copy, so that the batch is not held
            held.append([c.to_numpy().copy() for c in batch.columns])
            size += batch.num_rows
        if size >= _EDGE_ROWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _neighbor_lists(read: np.ndarray, nbr: np.ndarray, max_list: int) -> pa.RecordBatch:
    """Rows of :func:`neighbors` of all ends of some reads."""
    order = np.lexsort((nbr, read))
    read, nbr = read[order], nbr[order]
    new_read = np.append(True, read[1:] != read[:-1])
    kept = new_read | np.append(True, nbr[1:] != nbr[:-1])
    read, nbr, new_read = read[kept], nbr[kept], new_read[kept]
    start = np.flatnonzero(new_read)
    size = np.diff(np.append(start, len(read)))
    at = np.arange(len(read)) - np.repeat(start, size)
    first = np.flatnonzero(at % max_list == 0)
    parts = np.repeat(-(-size // max_list), size)[first]
    columns = [
        pa.array(read[first]),
        pa.array((at[first] // max_list).astype(np.int32)),
        pa.array(parts.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(read)), pa.int32()), pa.array(nbr)),
    ]
    return pa.record_batch(columns, names=["read_id", "part", "parts", "nbrs"])


def connected_components(edges: DataFrame, on_round=None, table: bool = False) -> DataFrame:
    """``(read_id, component)``: component = smallest read id in it.

    Random contraction (Bögeholz, Brand, Todor 2020). In each round every vertex
    picks the vertex of its closed neighbourhood with the smallest hash, then that
    vertex's own pick, and the graph is contracted to the picked vertices. At least a constant share of the
    vertices goes in each expected round, so rounds grow with the logarithm of
    the graph and the total work with its size, long chains included. Labels go back to the
    reads of a representative by pieces, so a component of all reads is no single join key.

    ``on_round(round, edge_count)`` is called after each round, for tests. With ``table``
    the edges are a table in which few repeat: they are read where they are.
    """
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    current = edges.select(u.alias("u"), v.alias("v")).filter("u != v")
    if not table:
        current = stage(current.distinct(), "cc-edges")
    picks: list[DataFrame] = []
    while not current.isEmpty():
        number = len(picks)
        pick = stage(_pick(current, number), "cc-pick")
        picks.append(pick)
        last, current = current, stage(_contract(current, pick), "cc-edges")
        release(last)
        if on_round is not None:
            on_round(number, current.count())
    if not picks:
        return current.select(F.col("u").alias("read_id"), F.col("v").alias("component"))
    # follow the picks from the last, smallest round back to the first
    label = picks[-1]
    for pick in reversed(picks[:-1]):
        later = label.select(F.col("x").alias("rep"), F.col("rep").alias("final"))
        label = join_one(pick, later, ["rep"], ["x"], "left").select("x", F.coalesce("final", "rep").alias("rep"))
    label = stage(label, "cc-labels")
    smallest = label.groupBy("rep").agg(F.min("x").alias("component"))
    return join_one(label, smallest, ["rep"], ["x"]).select(F.col("x").alias("read_id"), "component")


def _pick(edges: DataFrame, number: int) -> DataFrame:
    """``(x, rep)``: the vertex of the smallest hash among x and its neighbours."""

    def order(c: str):
        return F.xxhash64(F.lit(number), F.col(c))

    ends = F.array(
        F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
        F.struct(F.col("v").alias("x"), F.col("u").alias("y")),
    )
    best = (
        edges.select(F.inline(ends))
        .withColumn("h", order("y"))
        .groupBy("x")
        .agg(F.min("h").alias("h"), F.min_by("y", "h").alias("y"))
    )
    step = best.select("x", F.when(order("x") < F.col("h"), F.col("x")).otherwise(F.col("y")).alias("y"))
    # the pick of the pick is in the same component too, and saves rounds
    further = step.select(F.col("x").alias("y"), F.col("y").alias("rep"))
    return step.join(further, "y").select("x", "rep")


def _contract(edges: DataFrame, pick: DataFrame) -> DataFrame:
    mapped = edges.join(
        pick.select(F.col("x").alias("u"), F.col("rep").alias("ru")), "u"
    ).join(pick.select(F.col("x").alias("v"), F.col("rep").alias("rv")), "v")
    return (
        mapped.filter("ru != rv")
        .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        .distinct()
    )


def attach_components(reads: DataFrame, components: DataFrame) -> DataFrame:
    """``(read_id, component)`` for every read; one without edges is its own component."""
    return (
        reads.select("read_id")
        .join(components, "read_id", "left")
        .select("read_id", F.coalesce("component", "read_id").alias("component"))
    )


def component_nodes(components: DataFrame, neighbor_lists: DataFrame) -> DataFrame:
    """``(read_id, component, part, parts, nbrs)``: empty list for a read without neighbours."""
    none = F.array().cast("array<bigint>")
    return components.join(neighbor_lists, "read_id", "left").select(
        "read_id",
        "component",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce("nbrs", none).alias("nbrs"),
    )
