"""Dense numbering of rows in a global order, without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.staging import stage

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def _placed(df: DataFrame, order: list) -> DataFrame:
    """``df`` in range partitions, with ``_block`` (partition) and ``_position`` (place in it).

    Rows are range partitioned and sorted once. The position inside the partition is
    written with the rows, so it stays what it is when a task is repeated.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "indexed",
    )
    return placed.select(
        *df.columns,
        F.shiftright("_at", _POSITION_BITS).alias("_block"),
        F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_position"),
    )


def _block_starts(sizes: DataFrame) -> DataFrame:
    """``(_block, _start)`` from ``(_block, _rows)``, one row per partition.

    The unpartitioned window is bounded by the number of partitions.
    """
    return sizes.select("_block", F.expr("sum(_rows) over (order by _block) - _rows").alias("_start"))


def with_dense_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Add ``name``: 0, 1, 2, … in ``order``, which must be a total order.

    Only the row count per partition is joined back to the sorted rows: one small row
    per partition.
    """
    rows = _placed(df, order)
    starts = _block_starts(rows.groupBy("_block").agg(F.count("*").alias("_rows")))
    return rows.join(F.broadcast(starts), "_block").select(
        *df.columns, (F.col("_start") + F.col("_position")).alias(name)
    )


def with_group_position(
    df: DataFrame,
    keys: list[str],
    order: list,
    start: str = "start",
    position: str = "position",
    total: str = "total",
    ranges: tuple[str, ...] = (),
) -> DataFrame:
    """Number the rows of each key, without a join or a window on the key alone.

    Rows are ordered by ``keys`` and then ``order``, which together must be a total
    order. ``start`` is the dense number, over all rows, of the first row of the key (so
    it tells keys apart and keeps their order), ``position`` counts from 0 inside the
    key and ``total`` is the number of its rows. Null is a key like any other. For each
    column in ``ranges`` its least and greatest value in the key are added, as ``<c>_min``
    and ``<c>_max``.

    A key that holds most rows fills many range partitions. Its totals come from one row
    per partition and key, and go back to the rows by partition *and* key, so no task
    gets more rows than a range partition has.
    """
    rows = _placed(df, [*keys, *order])
    inner = [f(c).alias(f"{c}_{n}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]
    outer = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]
    added = [f"{c}_{n}" for c in ranges for n in ("min", "max")]
    runs = stage(
        rows.groupBy("_block", *keys).agg(F.min("_position").alias("_low"), F.count("*").alias("_rows"), *inner), "runs"
    )
    starts = _block_starts(runs.groupBy("_block").agg(F.sum("_rows").alias("_rows")))
    runs = runs.join(F.broadcast(starts), "_block").withColumn("_low", F.col("_low") + F.col("_start"))
    ends = runs.groupBy(*keys).agg(F.min("_low").alias(start), F.sum("_rows").alias(total), *outer)
    named = [F.col(k).alias(f"_of_{k}") for k in keys]
    ends = ends.select(*named, start, total, *added)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    of_run = runs.drop(*added).join(ends, same).select(F.col("_block").alias("_in"), *named, "_start", start, total, *added)
    found = rows.join(of_run, (F.col("_block") == F.col("_in")) & same)
    return found.select(
        *df.columns, start, (F.col("_start") + F.col("_position") - F.col(start)).alias(position), total, *added
    )


def list_parts(position: str, total: str, max_list: int) -> tuple[Column, Column]:
    """``part`` and ``parts`` of a row in a list of ``total`` rows held ``max_list`` to a part."""
    part = F.floor(F.col(position) / F.lit(max_list)).cast("int")
    parts = F.ceil(F.col(total) / F.lit(max_list)).cast("int")
    return part.alias("part"), parts.alias("parts")
