"""Benchmark decontamination: exact word windows of test items in training texts.

DataFrame functions only. A word is a run of letters and digits (A-Z in lower
case) or of anything outside ASCII. Items are cut into windows of ten words; an
item of fewer words is one window. The hashes of the windows of a document are
looked up in the set of item windows, and every hit is verified on the words.

Texts are cut into chunks of ``CHUNK`` words with the words a window needs beyond them,
and only a chunk stands beside each of its positions: work is linear in the length of a
text. The item windows are broadcast only after they have been counted and measured and
lie under ``BROADCAST_WINDOWS`` and ``BROADCAST_BYTES``; beyond either the same join is a
shuffled one. An empty table of items leaves every document clean, an empty table of
documents gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.llm.columns import fresh
from seqbin.staging import stage

WINDOW = 10
#: item windows, and bytes of their words and item ids, up to which they are broadcast
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
#: window starts in a chunk of a text
CHUNK = 64

#: leading words of a window that are looked up first
ANCHOR = 3

# ASCII that separates words becomes a blank, A-Z become lower case; all else stays
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """The words of a text, in order; empty for a null text."""
    plain = F.translate(
        F.coalesce(F.col(text).cast("string"), F.lit("")), _SEPARATORS + _UPPER, " " * len(_SEPARATORS) + _LOWER
    )
    return F.array_remove(F.split(plain, " ", -1), "")


def _windows(all_words: Column, size: int | Column) -> Column:
    """``array<struct<h, pos>>`` of the windows of a size; empty for shorter texts."""
    last = F.size(all_words) - size
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.slice(all_words, i + 1, size)).alias("h"), i.alias("pos")),
        ),
    )


def _chunks(all_words: Column, size: int) -> Column:
    """``array<struct<base, part>>``: the words from every ``CHUNK``-th on, for ``CHUNK`` windows each."""
    last = F.size(all_words) - size

    def chunk(base: Column) -> Column:
        end = F.least(base + (CHUNK + size - 2), F.size(all_words) - 1)
        part = F.transform(F.sequence(base, end), lambda i: F.get(all_words, i))
        return F.struct(base.alias("base"), part.alias("part"))

    bases = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(CHUNK))
    return F.when(last >= 0, F.transform(bases, chunk))


def _leads(part: Column, size: int, lead: int) -> Column:
    """Hashes of the first ``lead`` words of every window of a chunk, by position."""
    return F.transform(
        F.sequence(F.lit(0), F.size(part) - size),
        lambda i: F.xxhash64(*(F.get(part, i + j if j else i) for j in range(lead))),
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(size, h, gram, items)``: each distinct window with the items that hold it."""
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words().alias("w"))
        .filter((F.size("w") > 0) & F.col("item").isNotNull())
        .withColumn("size", F.least(F.size("w"), F.lit(window)))
    )
    return (
        items.select("item", "size", "w", F.explode(_windows(F.col("w"), F.col("size"))).alias("x"))
        .select("item", "size", F.col("x.h").alias("h"), F.slice("w", F.col("x.pos") + 1, F.col("size")).alias("gram"))
        .groupBy("size", "h", "gram")
        .agg(F.collect_set("item").alias("items"))
    )


def window_hits(docs: DataFrame, grams: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, pos, size, items)``: verified occurrences of item windows in documents."""
    held = F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " "))
    sizes = grams.groupBy("size").agg(F.count("*").alias("n"), F.sum(held * 4).alias("bytes"))
    counts = {r["size"]: r for r in sizes.collect()}  # at most `window` rows
    small = sum(r["n"] for r in counts.values()) <= broadcast_windows
    small = small and sum(r["bytes"] for r in counts.values()) <= BROADCAST_BYTES
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("w"))
    parts = []
    for size in sorted(counts):
        looked_up = grams.filter(F.col("size") == size).select("h", "gram", "items")
        chunks = tokens.select("doc_id", F.inline(_chunks(F.col("w"), size)))
        lead = min(ANCHOR, size)
        starts = chunks.select("doc_id", "base", "part", F.posexplode(_leads(F.col("part"), size, lead)).alias("at", "a"))
        if small:
            # the first words of a window are hashed everywhere, the whole window only where they match
            anchors = looked_up.select(F.xxhash64(*(F.get("gram", F.lit(j)) for j in range(lead))).alias("a")).distinct()
            starts = starts.join(F.broadcast(anchors), "a", "left_semi")
            looked_up = F.broadcast(looked_up)
        # what is shipped, if anything, is the window and not the text
        own = F.slice("part", F.col("at") + 1, size)
        hashed = starts.select("doc_id", (F.col("base") + F.col("at")).alias("pos"), own.alias("own"))
        hit = hashed.withColumn("h", F.xxhash64("own")).join(looked_up, "h").filter("own = gram")
        parts.append(hit.select("doc_id", "pos", F.lit(size).alias("size"), "items"))
    if not parts:
        return docs.select(
            F.col("doc_id").cast("long"), F.lit(0).alias("pos"), F.lit(0).alias("size"),
            F.array().cast("array<string>").alias("items"),
        ).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per document.

    A word inside any occurrence of a window is hit. Null and empty texts have no
    words; null item ids are ignored. A doc_id must be unique; rows that repeat one
    are told apart by nothing and share their hits.
    """
    hits = document_hits(docs, benchmark, window, broadcast_windows).withColumnRenamed("doc_id", "hit_doc")
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words()).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    ids = F.array_join(F.array_sort(F.coalesce("items", none)), ",")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def document_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc_id, n_hit, items)`` of the documents with a hit."""
    grams = stage(item_windows(benchmark, window), "item-windows")
    hits = window_hits(docs, grams, window, broadcast_windows)
    spans = (
        hits.groupBy("doc_id")
        .agg(
            F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("size")).alias("to")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["to"] - F.greatest(s["pos"], acc["to"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["to"], s["to"]).alias("to"),
        ),
    )["n"]
    return spans.select("doc_id", covered.alias("n_hit"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold an item window; all columns stay."""
    (key,) = fresh(docs, "hit_doc")
    bad = document_hits(docs, benchmark, window).select(F.col("doc_id").alias(key))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")


ORACLE = r"""
with item_words as (select cast(item_id as varchar) as item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_grams as (select distinct item, len(g) as size, array_to_string(g, ' ') as gram from (
    select item, w[i + 1 : i + least(len(w), 10)] as g
    from (select item, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) as i from item_words where len(w) > 0))),
sizes as (select distinct size from item_grams),
doc_words as (select doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
doc_grams as (select doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') as gram
              from (select doc_id, w, size, unnest(range(0, len(w) - size + 1)) as i
                    from doc_words cross join sizes where len(w) >= size)),
hits as (select d.doc_id, d.i, d.size, g.item from doc_grams d join item_grams g on d.size = g.size and d.gram = g.gram),
hit_words as (select doc_id, count(*) as n from
              (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
hit_items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids
              from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit,
       cast(coalesce(x.n, 0) as bigint) as n_items, sha256(coalesce(x.ids, '')) as items_sha256,
       coalesce(h.n, 0) > 0 as contaminated
from doc_words d left join hit_words h on d.doc_id = h.doc_id left join hit_items x on d.doc_id = x.doc_id"""
