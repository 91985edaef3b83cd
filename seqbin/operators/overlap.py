"""Read pairs that share k-mers.

Two reads overlap when they share at least ``m`` distinct k-mers. :func:`overlap_of_reads`
takes the pairs from :mod:`seqbin.operators.linked`. From tokens, and where k-mers are too long
to pack, they come from an equi self-join on the k-mer. Three things keep that cheap:

* A run of k-mers shared in the same order by both reads is counted from its two
  ends: the end row adds ``rank + 1``, the start row subtracts ``rank``. The rows
  in between never leave the join (tokens from ``kmer_tokens`` carry the links).
* A read may ignore its ``m - 1`` hottest k-mers when candidates are made: two
  reads sharing ``m`` k-mers still share one that neither ignores (prefix
  filtering, Chaudhuri et al. 2006). Shared ignored k-mers are added back.
* The rows of a hot k-mer are cut into blocks, and every pair of blocks is a join
  key of its own, so no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqbin.functions.dna import MAX_PACKED_K
from seqbin.operators.kmers import (
    UNLINKED,
    kmer_tokens,
    link_next,
    link_prev,
    link_rank,
    read_kmers,
)
from seqbin.operators.linked import linked_index, linked_pairs
from seqbin.operators.skew import hot_keys, sample_reads, sample_step
from seqbin.staging import stage

#: rows of one hot k-mer that meet in one join key
BLOCK_ROWS = 1024
_NO_LINK = UNLINKED * 9  # rank 0, unlinked on both sides


def hot_kmers(tokens: DataFrame, limit: int, step: int = 1) -> DataFrame:
    """``(kmer, n_est)`` for k-mers in more than ``limit`` reads.

    ``tokens`` may come from every ``step``-th read only.
    """
    return stage(hot_keys(tokens, "kmer", limit, step), "hot-kmers")


def overlap_edges(
    tokens: DataFrame,
    m: int,
    hot: DataFrame | None = None,
    hot_limit: int = 4096,
    within: str | None = None,
    across: str | None = None,
) -> DataFrame:
    """``(src, dst, weight)`` with ``src < dst``: pairs sharing at least ``m`` k-mers.

    ``tokens`` is ``(read_id, kmer)``, with an optional ``link``. ``within`` names
    a column both reads must agree on, ``across`` one they must differ in.
    Every such pair is returned, however hot its k-mers are.
    """
    if "link" not in tokens.columns:
        tokens = tokens.withColumn("link", F.lit(_NO_LINK).cast("bigint"))
    if hot is None:
        step = sample_step(hot_limit)
        hot = hot_kmers(sample_reads(tokens, step), hot_limit, step)
    keys = ["kmer"] if within is None else ["kmer", within]
    apart = None if across is None else F.col(f"a.{across}") != F.col(f"b.{across}")
    if hot.isEmpty():
        # most k-mers are in one read only; drop them while the rows are together anyway
        together = Window.partitionBy(*keys)
        shared = tokens.withColumn("n", F.count("*").over(together)).filter("n > 1").drop("n")
        return _weigh(_shared(stage(shared, "shared-kmers"), keys, apart)).filter(F.col("weight") >= m)

    several = tokens.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    shared = tokens.join(several, keys, "left_semi")
    marked = stage(ignore_hottest(shared, hot, m), "marked-kmers")
    kept = marked.filter(~F.col("ignored"))
    cold = _shared(kept.filter(F.col("n_est").isNull()), keys, apart)
    warm = _shared(_blocks(kept.filter(F.col("n_est").isNotNull())), [*keys, "lo", "hi"], apart, blocks=True)
    pairs = _weigh(cold.unionByName(warm))
    return add_ignored(pairs, marked).filter(F.col("weight") >= m)


def overlap_of_reads(
    reads: DataFrame, k: int, m: int, hot_limit: int = 4096, within: str | None = None
) -> DataFrame:
    """:func:`overlap_edges` of the k-mers of ``reads``.

    k-mers of up to 31 bases are packed, and pairs come from :func:`linked_index`, which
    cuts k-mers in more than ``hot_limit`` reads. Longer ones stay text and are joined; hot
    ones are then looked for in a fixed sample of the reads, chosen by hashed id.
    ``within`` is a column of ``reads`` on which both reads must agree. Reads of which some id
    occurs in several whole rows are joined as well: their k-mers count once per row, but once
    only where hot ones are ignored.
    """
    if within is None and k <= MAX_PACKED_K:
        reads = reads.filter("read_id is not null")  # without id in no pair
        if not _repeated_ids(reads):
            return linked_pairs(linked_index(reads, k, hot_limit), m)
    if within is not None:
        # the caller vouches that each group is small, so no k-mer is hot inside it
        tokens = any_tokens(reads, k, carry=within)
        kind = "bigint" if k <= MAX_PACKED_K else "string"
        none_hot = reads.sparkSession.createDataFrame([], f"kmer {kind}, n_est bigint")
        return overlap_edges(tokens, m, hot=none_hot, within=within)
    step = sample_step(hot_limit)
    hot = hot_kmers(any_tokens(sample_reads(reads, step), k), hot_limit, step)
    return overlap_edges(any_tokens(reads, k), m, hot=hot)


def _repeated_ids(reads: DataFrame) -> bool:
    """Whether a read id stands in several rows, other than the parts of a split read."""
    whole = F.count_if(F.expr("parts = 1")) if "parts" in reads.columns else F.count("*")
    rows = reads.groupBy("read_id").agg(F.count("*").alias("n"), whole.alias("whole"))
    return not rows.filter("n > 1 and whole > 0").isEmpty()


def any_tokens(reads: DataFrame, k: int, carry: str | None = None) -> DataFrame:
    """Packed tokens where ``k`` allows it, text k-mers beyond."""
    return kmer_tokens(reads, k, carry) if k <= MAX_PACKED_K else read_kmers(reads, k, carry)


def _shared(
    rows: DataFrame, keys: list[str], apart: Column | None, blocks: bool = False
) -> DataFrame:
    """One row per end of a shared run: ``(src, dst, delta)``."""
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col("a.read_id") < F.col("b.read_id")
    for key in keys:
        on = on & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    if apart is not None:
        on = on & apart
    if blocks:
        on = on & ((F.col("a.lo") == F.col("a.hi")) | (F.col("a.block") != F.col("b.block")))
    left, right = F.col("a.link"), F.col("b.link")
    starts = (link_prev(left) != link_prev(right)) | (link_prev(left) == UNLINKED)
    ends = (link_next(left) != link_next(right)) | (link_next(left) == UNLINKED)
    delta = F.when(ends, link_rank(left) + 1).otherwise(0) - F.when(starts, link_rank(left)).otherwise(0)
    return a.join(b, on & (starts | ends)).select(
        F.col("a.read_id").alias("src"), F.col("b.read_id").alias("dst"), delta.alias("delta")
    )


def _weigh(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.sum("delta").alias("weight"))


def ignore_hottest(tokens: DataFrame, hot: DataFrame, m: int) -> DataFrame:
    """Add ``n_est`` and ``ignored``; links to ignored k-mers are cut."""
    hottest = Window.partitionBy("read_id").orderBy(F.desc_nulls_last("n_est"), "kmer")
    reading = Window.partitionBy("read_id").orderBy(link_rank(F.col("link")), "kmer")
    flagged = tokens.join(hot, "kmer", "left").withColumn(
        "ignored", F.col("n_est").isNotNull() & (F.row_number().over(hottest) < m)
    )
    around = flagged.withColumn(
        "cut_prev", F.coalesce(F.lag("ignored").over(reading), F.lit(False))
    ).withColumn("cut_next", F.coalesce(F.lead("ignored").over(reading), F.lit(False)))
    link = F.col("link")
    prev = F.when(F.col("cut_prev"), UNLINKED).otherwise(link_prev(link))
    after = F.when(F.col("cut_next"), UNLINKED).otherwise(link_next(link))
    relinked = F.shiftleft(link_rank(link), 6) + prev * 8 + after
    return around.withColumn("link", relinked.cast("bigint")).drop("cut_prev", "cut_next")


def _blocks(rows: DataFrame) -> DataFrame:
    """Repeat each row once per block it has to meet, keyed by the block pair."""
    blocks = F.ceil(F.col("n_est") / F.lit(BLOCK_ROWS)).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("read_id"), blocks).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def add_ignored(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Add the shared k-mers that at least one of the two reads ignored."""
    # at most m - 1 ignored and at most all k-mers of one read: bounded by the read
    lists = (
        marked.filter(F.col("n_est").isNotNull())
        .groupBy("read_id")
        .agg(
            F.collect_list(F.when(F.col("ignored"), F.col("kmer"))).alias("ignored"),
            F.collect_list(F.when(~F.col("ignored"), F.col("kmer"))).alias("used"),
        )
    )
    a = lists.select(F.col("read_id").alias("src"), F.col("ignored").alias("ia"), F.col("used").alias("ua"))
    b = lists.select(F.col("read_id").alias("dst"), F.col("ignored").alias("ib"), F.col("used").alias("ub"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")

    def common(x: str, y: str) -> Column:
        return F.coalesce(F.size(F.array_intersect(x, y)), F.lit(0))

    extra = common("ia", "ib") + common("ia", "ub") + common("ua", "ib")
    return both.select("src", "dst", (F.col("weight") + extra).alias("weight"))


def index_pairs(kmer_index: DataFrame) -> DataFrame:
    """``(kmer, src, dst)``: all read pairs of each k-mer of an inverted index.

    Pairs inside one array need no shuffle. Only k-mers held in several rows are
    joined, one pair of rows at a time.
    """
    rows = kmer_index
    if "parts" not in rows.columns:
        counts = rows.groupBy("kmer").agg(F.count("*").alias("parts"))
        rows = rows.join(counts, "kmer").withColumn("part", F.get("adjacency", F.lit(0)))
    later = F.expr("slice(adjacency, pos + 2, size(adjacency))")
    inside = (
        rows.select("kmer", "adjacency", F.posexplode("adjacency").alias("pos", "src"))
        .filter("pos + 1 < size(adjacency)")
        .select("kmer", "src", F.explode(later).alias("dst"))
    )
    several = rows.filter("parts > 1").select("kmer", "part", "adjacency")
    one, two = several.alias("one"), several.alias("two")
    between = (
        one.join(two, (F.col("one.kmer") == F.col("two.kmer")) & (F.col("one.part") < F.col("two.part")))
        .select(F.col("one.kmer").alias("kmer"), F.explode("one.adjacency").alias("x"), F.col("two.adjacency").alias("ys"))
        .select("kmer", "x", F.explode("ys").alias("y"))
        .select("kmer", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    )
    return inside.unionByName(between)
