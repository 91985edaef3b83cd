"""Near-duplicate documents by HyperMinHash registers, banding and exact checks.

1. *Sketch.* Each text becomes ``REGISTERS`` 16-bit registers: its shingles are
   dealt to buckets by hash, and a bucket keeps its smallest hash as the number
   of leading zeros plus ten mantissa bits. An empty bucket borrows the register
   of the first filled bucket in a fixed order of its own.
2. *Copies.* Texts with the same words form one representative; only
   representatives go on.
3. *Bands.* Five registers make a band; representatives that share a band meet in
   a bucket. At a similarity of 0.8 all 36 bands miss with probability 6e-7.
4. *Centres.* In a bucket everyone is paired with one centre only: the member
   whose buckets are fullest. Pairs are estimated with the collision-corrected
   Jaccard estimate, then checked on the full sets.
5. *The rest.* Buckets whose members are not in one component yet go through an
   exact stage. A text in which more than a fifth of the shingles occur in no
   other text of these buckets has no partner at all and leaves. What remains is
   compared by blocks of bounded size, which emit links only, never pairs.

The components are then the connected components of all checked links. A link
at exactly 0.8 can be lost only if all 36 bands differ.

Long texts are sketched and compared whole; an empty table gives no rows. The other cases are
defined at :func:`near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.llm import hashing
from seqbin.llm.memory import give_back
from seqbin.operators.graph import connected_components
from seqbin.staging import stage

BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: shingles of one side of a block of the exact stage; a text counts for TEXT_SHINGLES more
BLOCK_SHINGLES = 200_000
TEXT_SHINGLES = 100

_rng = np.random.Generator(np.random.PCG64(77))
#: rank of bucket j in the borrowing order of bucket i
_BORROW = np.argsort(np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1), axis=1).astype(np.int16)
_BAND_PLACE = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SEED = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def registers(texts: int, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``(texts, REGISTERS)`` uint16 from distinct shingles; all zero for a text without any."""
    out = np.zeros((texts, REGISTERS), np.uint16)
    if not len(doc):
        return out
    smallest = np.full(texts * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    slot = doc * REGISTERS + ((value >> np.uint64(33)) % np.uint64(REGISTERS)).astype(np.int64)
    np.minimum.at(smallest, slot, hashing.mix(value ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1))
    smallest = smallest.reshape(texts, REGISTERS)
    filled = smallest != np.iinfo(np.uint64).max
    bits = np.frexp(smallest.astype(np.float64))[1].astype(np.int64)
    shift = bits - 1 - MANTISSA
    mantissa = np.where(
        shift >= 0,
        smallest >> np.maximum(shift, 0).astype(np.uint64),
        smallest << np.maximum(-shift, 0).astype(np.uint64),
    ) & np.uint64((1 << MANTISSA) - 1)
    zeros = np.clip(63 - bits, 0, 62).astype(np.uint64)
    out[:] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    count = filled.sum(axis=1)
    for row in np.flatnonzero((count < REGISTERS) & (count > 0)):
        have = np.flatnonzero(filled[row])
        lack = np.flatnonzero(~filled[row])
        out[row, lack] = out[row, have[np.argmin(_BORROW[np.ix_(lack, have)], axis=1)]]
    out[count == 0] = 0
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """``(texts, BANDS)`` int64 keys of the compressed registers of each band."""
    parts = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return hashing.mix((parts * _BAND_PLACE).sum(axis=2, dtype=np.uint64) ^ _BAND_SEED).view(np.int64)


def chance_matches(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance for sets of these sizes."""
    zeros = np.arange(1, 46, dtype=np.float64)[:, None]

    def shares(n):
        load = np.maximum(np.asarray(n, np.float64), 1) / REGISTERS
        low = (1 - 2.0**-zeros) ** load
        high = (1 - 2.0 ** (1 - zeros)) ** load
        return low - high

    return (shares(n_a) * shares(n_b)).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows, corrected for chance matches."""
    chance = chance_matches(n_a, n_b)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def may_link(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """False only for pairs whose estimate lies five deviations below the threshold."""
    t = percent / 100
    seen = np.minimum(REGISTERS, np.minimum(n_a, n_b)).astype(np.float64)
    return estimate(a, b, n_a, n_b) >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(seen, 1)) - 0.02


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, words_key, n_shingles, sketch)`` of ``(doc_id, text)``.

    ``words_key`` is 128 bits over the whole word sequence; null without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in hashing.text_slices(texts):
                found = hashing.words(texts.slice(lo, hi - lo))
                doc, value = hashing.shingles(found, size)
                counts = np.bincount(doc, minlength=hi - lo)
                sketches = registers(hi - lo, doc, value)
                ends = np.cumsum(found.counts)
                raw = found.hash.tobytes()
                keys = [
                    xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None
                    for a, b in zip((ends - found.counts).tolist(), ends.tolist(), strict=True)
                ]
                yield pa.record_batch(
                    [
                        ids.slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([r.tobytes() for r in sketches], pa.binary()),
                    ],
                    names=["doc_id", "words_key", "n_shingles", "sketch"],
                )
            del batch, ids, texts
            give_back()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, words_key binary, n_shingles long, sketch binary"
    )


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(rep, shingles)``: the full sorted set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in hashing.text_slices(texts):
                doc, value = hashing.shingles(hashing.words(texts.slice(lo, hi - lo)), size)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.record_batch([ids.slice(lo, hi - lo).cast(pa.int64()), sets], names=["rep", "shingles"])
            del batch, ids, texts
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, shingles array<long>")


def _band_rows(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(rows, REGISTERS)
            keys = band_keys(sketches).reshape(-1)
            yield pa.record_batch(
                [pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "rep"]
            )

    return reps.select("rep", "sketch").mapInArrow(run, "band long, rep long")


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link, by size and by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b, s_a, s_b = (batch.column(i) for i in range(6))
            s_a, s_b = (
                np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, REGISTERS) for s in (s_a, s_b)
            )
            keep = pa.array(may_link(s_a, s_b, n_a.to_numpy(), n_b.to_numpy(), percent))
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])
            del batch, a, b, n_a, n_b, s_a, s_b, keep
            give_back()

    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (
        pairs.filter(100 * small >= percent * large)
        .select("a", "b", "n_a", "n_b", "s_a", "s_b")
        .mapInArrow(run, "a long, b long")
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - F.col("shared")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("shared", shared)
        .filter(100 * F.col("shared").cast("long") >= percent * union.cast("long"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the two sides of every block; at most one per text and component."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        _, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(rep)), np.diff(ends))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.zeros(len(rep), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        on_left = side[owner] == 0
        both = np.intersect1d(code[on_left], code[~on_left])
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(both), 4096):
            some = both[at : at + 4096]
            where = np.minimum(np.searchsorted(some, code), len(some) - 1)
            hit = some[where] == code
            x = np.zeros((len(left), len(some)), np.float32)
            y = np.zeros((len(right), len(some)), np.float32)
            x[place[owner[hit & on_left]], where[hit & on_left]] = 1
            y[place[owner[hit & ~on_left]], where[hit & ~on_left]] = 1
            shared += x @ y.T
        sizes = np.diff(ends)
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        ok = (100 * shared.astype(np.int64) >= percent * union.astype(np.int64)) & (
            comp[left][:, None] != comp[right][None, :]
        )
        i, j = np.nonzero(ok)
        _, first = np.unique(np.stack([i, comp[right][j]], axis=1), axis=0, return_index=True)
        return pa.table({"src": rep[left][i[first]], "dst": rep[right][j[first]]})

    return rows.groupBy("band", "lblock", "rblock").applyInArrow(run, "src long, dst long")


def _numbers(count: str):
    return F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)


def _rest_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket, exactly.

    ``members (band, rep)``, ``labels (rep, component)``.
    """

    def open_buckets(rows: DataFrame) -> DataFrame:
        mixed = (
            rows.groupBy("band")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "rep").alias("c"))
            .filter("lo <> hi")
        )
        return rows.join(mixed.select("band"), "band", "left_semi")

    rows = members.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = stage(open_buckets(rows), "open-buckets")
    if rows.isEmpty():
        return rows.select(F.col("rep").alias("src"), F.col("rep").alias("dst")).limit(0)
    involved = sets.join(rows.select("rep").distinct(), "rep", "left_semi")
    own = (
        involved.select("rep", F.explode("shingles").alias("h"))
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
        .filter("n = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("own"))
    )
    # all but t of the larger set must be shared, so more shingles of its own than that exclude every partner
    alive = (
        involved.join(own, "rep", "left")
        .withColumn("n", F.size("shingles"))
        .filter(100 * F.coalesce("own", F.lit(0)) <= (100 - percent) * F.col("n"))
        .select("rep", "n", "shingles")
    )
    alive = stage(alive, "open-sets")
    rows = stage(open_buckets(rows.join(alive.select("rep", "n"), "rep")), "open-rows")
    if rows.isEmpty():
        return rows.select(F.col("rep").alias("src"), F.col("rep").alias("dst")).limit(0)
    # the largest component of a bucket is only compared with the others
    weight = F.sum(F.col("n") + TEXT_SHINGLES)
    parts = rows.groupBy("band", "component").agg(weight.alias("m"), F.count("*").alias("k"))
    whole = parts.groupBy("band").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"),
        F.sum("m").alias("all_m"),
        F.max(F.struct("k", "component", "m"))["m"].alias("main_m"),
    )

    def blocks(m):
        return F.ceil(m / F.lit(BLOCK_SHINGLES)).cast("int") + 1

    dealt = (
        rows.join(whole, "band")
        .withColumn("lblocks", blocks(F.col("all_m") - F.col("main_m")))
        .withColumn("rblocks", blocks(F.col("all_m")))
        .withColumn("deal", F.abs(F.xxhash64("rep")))
    )
    left = dealt.filter("component <> main").select(
        "band", "rep", "component", F.lit(0).alias("side"), (F.col("deal") % F.col("lblocks")).alias("lblock"),
        F.explode(_numbers("rblocks")).alias("rblock"),
    )
    right = dealt.select(
        "band", "rep", "component", F.lit(1).alias("side"),
        F.explode(_numbers("lblocks")).alias("lblock"),
        (F.col("deal") % F.col("rblocks")).alias("rblock"),
    )
    sided = left.unionByName(right).join(alive.select("rep", "shingles"), "rep")
    return _block_links(sided, percent).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of ``(doc_id, text)``.

    Two texts are linked if ``100 * shared >= percent * union`` over their sets of
    distinct ``size``-word shingles. ``component_id`` is the smallest doc_id
    reachable over links; ``kept`` marks that document. A text that is null, empty
    or blank has no shingles, is linked with nothing and is kept. Copies of any
    length are linked. Rows that repeat a doc_id repeat in the result (they should
    carry the same text; else one of their texts stands for the id); a null
    doc_id is kept as a row of its own with a null component. Columns other than
    doc_id and text are ignored.
    """
    if not 1 <= size <= hashing.MAX_SHINGLE:
        raise ValueError(f"size must be 1 to {hashing.MAX_SHINGLE}")
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stage(sketch_documents(docs, size), "sketches")
    usable = sketched.filter("doc_id is not null and words_key is not null")
    copies = usable.groupBy("words_key").agg(F.min("doc_id").alias("rep"))
    firsts = usable.groupBy("doc_id").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    copies = stage(copies, "copies")
    reps = stage(
        copies.select("rep").distinct().join(firsts.withColumnRenamed("doc_id", "rep"), "rep"), "representatives"
    )

    rows = _band_rows(reps)
    shared = rows.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    members = stage(rows.join(shared, "band"), "band-members")
    weight = members.groupBy("rep").agg(F.sum("c").alias("w"))
    weighted = stage(members.join(weight, "rep"), "weighted")
    centre = weighted.groupBy("band").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("a"))
    pairs = (
        weighted.join(centre, "band")
        .filter("rep <> a")
        .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
        .distinct()
    )
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    hopeful = stage(_estimated(pairs.join(a, "a").join(b, "b"), percent), "hopeful")

    texts = docs
    if not sketched.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    met = members.select("rep").distinct()
    sets = stage(
        shingle_sets(texts.join(met.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), size), "shingle-sets"
    )
    links = stage(_linked(hopeful, sets, percent), "links")
    labels = stage(connected_components(links), "labels").withColumnRenamed("read_id", "rep")
    more = stage(_rest_links(members.select("band", "rep"), labels, sets, percent), "more-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = stage(connected_components(links), "labels").withColumnRenamed("read_id", "rep")

    groups = copies.join(labels, "rep", "left").select(
        "words_key", F.coalesce("component", "rep").alias("component_id")
    )
    return (
        sketched.select("doc_id", "words_key", "n_shingles")
        .join(groups, "words_key", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; the columns and all other rows stay.

    Of rows that repeat a doc_id all stay or go together.
    """
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
