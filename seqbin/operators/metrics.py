"""Confusion counts and precision / recall / F-measure of a binning.

Two conventions exist for which side's maximum counts as precision. With
``label_max`` precision sums, over the true labels, the largest cluster share,
and recall sums, over the clusters, the largest label share. ``cluster_max``
swaps the two numerators. When unassigned reads (-1) are discarded they leave
both numerators and the precision denominator, but stay in that of the recall.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.operators.clusters import UNASSIGNED

CONVENTIONS = ("label_max", "cluster_max")
#: columns a wide matrix may get from the labels of a table
MOST_LABELS = 1_000


def confusion_long(labels: DataFrame) -> DataFrame:
    """``(label, predict, n)``."""
    return labels.groupBy("label", "predict").agg(F.count("*").alias("n"))


def label_values(labels: DataFrame, first: Iterable[str] = (), most: int = MOST_LABELS) -> list[str | None]:
    """The labels of ``first``, then all others of the table in ascending order, null last.

    More than ``most`` labels in the table are an error: none is left out.
    """
    found = {r.label for r in labels.select("label").distinct().limit(most + 1).collect()}
    if len(found) > most:
        raise ValueError(f"more than {most} labels: too many for a wide matrix")
    values = list(dict.fromkeys(first))
    return values + sorted(found - {*values, None}) + [None] * (None in found)


def confusion_matrix(labels: DataFrame, values: list[str | None]) -> DataFrame:
    """One row per predict, one column per label of ``values``, 0 where a pair is absent.

    Labels that are not listed are left out; the width is the caller's choice
    (:func:`label_values` lists them all). A listed null gets the column ``null``, with
    underscores behind it if a label has that name.
    """
    names = [value for value in values if value is not None]
    if "predict" in map(str.lower, names):
        raise ValueError("a label has the name of the column predict")
    counts = confusion_long(labels)
    if None in values:
        null = "null"
        while null in map(str.lower, names):
            null += "_"
        # a label that is not listed must not pass for the null
        shown = F.when(F.col("label").isNull(), null).when(F.col("label").isin(names), F.col("label"))
        counts, names = counts.withColumn("label", shown), [*names, null]
    return counts.groupBy("predict").pivot("label", names).agg(F.sum("n")).fillna(0)


def binning_metrics(
    labels: DataFrame, discard: bool = True, convention: str = "label_max"
) -> DataFrame:
    """One row ``(precision, recall, f_measure)``; null where nothing was assigned."""
    return _metrics_of_counts(confusion_long(labels), discard, convention)


def _metrics_of_counts(counts: DataFrame, discard: bool, convention: str) -> DataFrame:
    counted = (F.col("predict") != UNASSIGNED) if discard else F.lit(True)
    # each count is seen from both of its sides, so the labels are read once
    sides = F.array(
        F.struct(F.lit("label").alias("side"), F.col("label").alias("key")),
        F.struct(F.lit("cluster").alias("side"), F.col("predict").cast("string").alias("key")),
    )
    counts = counts.select("n", F.when(counted, F.col("n")).alias("used"), F.inline(sides))
    best = counts.groupBy("side", "key").agg(
        F.max("used").alias("best"), F.sum("n").alias("total"), F.sum("used").alias("used")
    )

    def summed(side: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(column))), F.lit(0))

    row = best.agg(
        summed("label", "best").alias("label_sum"),
        summed("cluster", "best").alias("cluster_sum"),
        summed("label", "total").alias("total"),
        summed("label", "used").alias("used"),
    )
    return row.select(*_scores(convention))


def metrics_from_matrix(
    matrix: DataFrame, discard: bool = True, convention: str = "cluster_max"
) -> DataFrame:
    """:func:`binning_metrics` from a :func:`confusion_matrix`; null scores for an empty one."""
    names = [name for name in matrix.columns if name != "predict"]
    cells = [F.struct(F.lit(name).alias("label"), F.col(f"`{name.replace('`', '``')}`").cast("bigint").alias("n")) for name in names]
    none = F.array().cast("array<struct<label:string,n:bigint>>")
    long = matrix.select("predict", F.inline(F.array(*cells) if cells else none))
    return _metrics_of_counts(long, discard, convention)


def _scores(convention: str) -> list[Column]:
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}, not {convention!r}")
    by_label = convention == "label_max"
    p_num, r_num = ("label_sum", "cluster_sum") if by_label else ("cluster_sum", "label_sum")
    precision = F.col(p_num).cast("double") / F.nullif(F.col("used"), F.lit(0))
    recall = F.col(r_num).cast("double") / F.nullif(F.col("total"), F.lit(0))
    f_measure = F.lit(2.0) / (F.lit(1.0) / precision + F.lit(1.0) / F.nullif(recall, F.lit(0.0)))
    return [precision.alias("precision"), recall.alias("recall"), f_measure.alias("f_measure")]
