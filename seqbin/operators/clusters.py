"""k-means over group vectors, and labels carried back to reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.operators.results import one_per_read
from seqbin.staging import stage

#: prediction of reads that are in no clustered group
UNASSIGNED = -1
#: numbers handled at once when points are compared with centres
_CELLS = 1 << 22


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, the first of equals; memory is bounded for any number of centres."""
    step = max(1, _CELLS // centers.size)
    found = [
        ((points[i : i + step, None, :] - centers) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(points), step)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def assign_groups(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(group_id, prediction)``: the nearest centre of each ``(group_id, features)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch), centers) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(near, pa.int32())], names=["group_id", "prediction"])

    kind = points.schema["group_id"].dataType.simpleString()
    return points.select("group_id", "features").mapInArrow(run, f"group_id {kind}, prediction int")


def mean_vectors(points: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The means of the points nearest to each centre; a centre without points stays.

    Every task sends one row per centre. What is collected has one number per centre and
    dimension, however many points there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch)
                near = _nearest(matrix, centers)
                np.add.at(sums, near, matrix)
                counts += np.bincount(near, minlength=len(centers))
        used = np.flatnonzero(counts)
        rows = pa.array(list(sums[used]), pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used]), rows], names=["c", "n", "sums"])

    partial = points.select("group_id", "features").mapInArrow(run, "c long, n long, sums array<double>")
    totals = (
        partial.select("c", "n", F.posexplode("sums").alias("at", "value"))
        .groupBy("c", "at")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("total"))
        .collect()
    )
    moved = centers.copy()
    for r in totals:
        moved[r["c"], r["at"]] = r["total"] / r["n"]
    return moved


def cluster_groups(vectors: DataFrame, k: int, max_iter: int = 100, seed: int = 7) -> DataFrame:
    """``(group_id, prediction)``; groups without features are left out of the fit and get -1.

    k-means from ``k`` fixed starts: of all different vectors those whose group has
    the smallest hash (under ``seed``). So the start does not depend on partitions or
    cluster settings. With fewer different vectors there are fewer clusters. Rounds go on
    until no mean moves by more than rounding, or ``max_iter``: then every group is at its
    nearest centre and every centre is the mean of its groups.
    """
    known = vectors.filter(F.col("features").isNotNull())
    points = stage(known.select("group_id", "features"), "points")
    without = vectors.filter(F.col("features").isNull()).select(
        "group_id", F.lit(UNASSIGNED).alias("prediction")
    )
    order = F.min(F.struct(F.xxhash64(F.lit(seed), "group_id").alias("h"), F.col("group_id").alias("g")))
    starts = [
        r.features for r in points.groupBy("features").agg(order.alias("o")).orderBy("o").limit(k).collect()
    ]  # k rows
    if not starts:
        return without
    centers = np.array(starts, float)
    for _ in range(max_iter):
        moved = mean_vectors(points, centers)
        settled = np.abs(moved - centers).max() <= 1e-12
        centers = moved
        if settled:
            break
    return assign_groups(points, centers).unionByName(without)


def label_groups(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(read_id, predict)``: each group member with the cluster of its group, or -1."""
    return groups.select("group_id", "read_id").join(clusters, "group_id", "left").select(
        "read_id", F.coalesce("prediction", F.lit(UNASSIGNED)).alias("predict")
    )


def label_reads(reads: DataFrame, group_labels: DataFrame) -> DataFrame:
    """``(read_id, label, predict)``, one row per read; -1 when it has no group."""
    return (
        one_per_read(reads)
        .select("read_id", "label")
        .join(group_labels, "read_id", "left")
        .select("read_id", "label", F.coalesce("predict", F.lit(UNASSIGNED)).alias("predict"))
    )
