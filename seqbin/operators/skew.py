"""Finding hot keys before rows are shuffled on them.

What is found here only chooses how rows are spread over tasks; results do not
depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: one row in so many is looked at when the limit is large enough to show in a sample
SAMPLE_STEP = 64


def sample_step(limit: int) -> int:
    """Rows per sampled row for keys above ``limit``: 1 when the limit is small."""
    return SAMPLE_STEP if limit >= 16 * SAMPLE_STEP else 1


def sample_reads(reads: DataFrame, step: int) -> DataFrame:
    """The reads whose hashed id is divisible by ``step``: the same ones at any partitioning."""
    if step == 1:
        return reads
    return reads.filter(F.pmod(F.xxhash64("read_id"), F.lit(step)) == 0)


def hot_keys(rows: DataFrame, key: str, limit: int, step: int = 1) -> DataFrame:
    """``(key, n_est)`` for keys in more than ``limit`` rows; ``step`` as for the sample."""
    return (
        rows.groupBy(key)
        .agg((F.count("*") * step).alias("n_est"))
        .filter(F.col("n_est") > limit)
    )


#: join keys that the rows of one key are spread over
PIECES = 128


def join_one(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``keys``, however many rows a key has.

    The rows of a key are cut into up to ``PIECES`` by the hash of the columns ``by``; the row
    of ``table`` is repeated for the pieces that occur, and rows join it by key and piece. So
    the rows of a hot key go to many tasks. ``rows`` are read twice and should be a table.
    """
    cut = rows.withColumn("_piece", F.pmod(F.xxhash64(*by), F.lit(PIECES)))
    places = cut.select(*keys, "_piece").distinct().join(table, keys)
    return cut.join(places, [*keys, "_piece"], how).drop("_piece")
