"""Removal of lines that spread over many sites, with DataFrame functions only.

A line is trimmed text between line feeds. Its spread is the number of distinct
sites (here: ``source``) it occurs on, a null site counting as one. Per line hash a
HyperLogLog sketch of the sites is merged over all tasks, so a line in a third of
all documents costs one small sketch per task. Lines whose estimate lies near the
threshold get an exact distinct count; only these are shuffled again. The first
occurrence (smallest doc_id, then first in the text) of a spread line stays, all
others go.

Whatever is joined by line goes by line and piece (a hash of the doc_id), so the rows
of a line in a third of all documents reach many tasks. Work is linear in the length
of a text and in the number of its lines. An empty table gives no rows, null and empty
texts lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.llm.columns import fresh
from seqbin.operators.skew import PIECES, join_one
from seqbin.staging import stage

#: lines with fewer words are never removed
MIN_WORDS = 3
#: sites from which a line counts as boilerplate
MIN_SITES = 3
#: lines of more words than this count from LONG_SITES sites on: they do not recur by chance
LONG_WORDS = 50
LONG_SITES = 2
#: 2^LOG_K registers: a relative error of about 1.6 percent
LOG_K = 12
#: estimates within this share of the threshold are counted exactly (over ten deviations)
NEAR = 0.2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _threshold(words: Column) -> Column:
    return F.when(words > LONG_WORDS, F.lit(LONG_SITES)).otherwise(F.lit(MIN_SITES))


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, site, line, words)``: one row per line that may be boilerplate.

    ``line`` is a 128-bit key (two independent 64-bit hashes) of the trimmed text.
    """
    trimmed = F.trim(F.col("raw"))
    blank = F.length(F.translate("trimmed", " \t\r\x0b\x0c", "")) == 0
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("site"),
            F.posexplode(_lines(F.col("text").cast("string"))).alias("pos", "raw"),
        )
        .withColumn("trimmed", trimmed)
        .filter(~blank)
        .withColumn("words", F.size(F.split("trimmed", r"\s+")))
        .filter(F.col("words") >= MIN_WORDS)
        .select(
            "doc_id", "pos", "site", F.xxhash64("trimmed").alias("h1"),
            F.xxhash64(F.lit(17), "trimmed", F.length("trimmed")).alias("h2"), "words",
        )
    )


def repeated_rows(rows: DataFrame) -> DataFrame:
    """The line rows whose line occurs on two sites at least; all others cannot spread.

    The sites of a line are compared per piece first, so a hot line is ``PIECES`` rows at
    most when its pieces meet, and its rows look their own piece up.
    """
    line, piece = ["h1", "h2"], F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).alias("piece")
    own = rows.withColumn("piece", piece)
    pieces = stage(own.groupBy(*line, "piece").agg(F.min("site").alias("a"), F.max("site").alias("b")), "line-pieces")
    wide = pieces.groupBy(*line).agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select(*line)
    places = pieces.select(*line, "piece").join(wide, line, "left_semi")
    return own.join(places, [*line, "piece"], "left_semi").drop("piece")


def sketches(rows: DataFrame) -> DataFrame:
    """``(h1, h2, first, need, sites)``: estimated spread and first occurrence per line."""
    return rows.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        _threshold(F.max("words")).alias("need"),
    )


def boilerplate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spread)``: rows of repeated lines, and the spread lines with their first occurrence."""
    rows = stage(repeated_rows(line_rows(docs)), "repeated-lines")
    found = stage(sketches(rows), "line-sketches")
    need = F.col("need")
    surely = found.filter(F.col("sites") > need * (1 + NEAR)).select("h1", "h2", "first")
    near = found.filter(F.col("sites").between(need * (1 - NEAR), need * (1 + NEAR)))
    exact = (
        join_one(rows, near.select("h1", "h2"), ["h1", "h2"], ["doc_id"])
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("exact"))
    )
    counted = (
        near.join(exact, ["h1", "h2"]).filter(F.col("exact") >= need).select("h1", "h2", "first")
    )
    return rows, stage(surely.unionByName(counted), "spread-lines")


def removed_positions(docs: DataFrame) -> DataFrame:
    """``(doc_id, gone)``: the positions of the lines that go, per document that loses any."""
    rows, spread = boilerplate(docs)
    return (
        join_one(rows.select("doc_id", "pos", "h1", "h2"), spread, ["h1", "h2"], ["doc_id"])
        .filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc_id")
        .agg(F.collect_set("pos").alias("gone"))
    )


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone``, in time linear in its lines."""

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # an array of one, so the text is cut once and not per line
    return F.get(F.transform(F.array(_lines(text)), left), F.lit(0))


def _cleaned(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` joined with what goes, the removed positions (null: none) and the text left."""
    key, gone = fresh(docs, "line_doc", "gone")
    removed = removed_positions(docs).toDF(key, gone)
    clean = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(gone)))
    return docs.join(removed, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left"), F.col(gone), clean


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with spread lines removed from ``text``; all columns and their order stay.

    A document that loses every line with text is dropped: all it said stands in
    earlier documents. One that had no text before stays as it is, as do null texts.
    A column ``n_chars`` follows the new text. Rows that repeat a doc_id are treated alike.
    """
    done, gone, clean = _cleaned(docs.withColumn("text", F.col("text").cast("string")))
    emptied = gone.isNotNull() & (F.length(F.translate(clean, " \t\r\n\x0b\x0c", "")) == 0)

    def column(name: str) -> Column:
        if name == "text":
            return clean.alias("text")
        if name == "n_chars":
            same = F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(clean))
            return same.cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"`{name}`")

    return done.filter(~emptied).select(*(column(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, clean_sha256)`` per row of ``(doc_id, text, source)``.

    ``n_lines`` counts all pieces between line feeds (0 for a null text);
    ``clean_sha256`` is that of the text left (null text: of nothing).
    """
    text = F.col("text").cast("string").alias("text")
    done, gone, clean = _cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, "source"))
    return done.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(clean, F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


ORACLE = f"""
with docs as (select doc_id, coalesce(source, '') as source, string_split(text, chr(10)) as ls, text from documents),
pieces as (select doc_id, source, unnest(range(0, len(ls))) as pos, unnest(ls) as raw from docs),
rows as (select doc_id, source, pos, trim(raw, ' ') as line, len(string_split_regex(trim(raw, ' '), '\\s+')) as words
         from pieces where trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
spread as (select line, min(struct_pack(d := doc_id, p := pos)) as first from rows where words >= {MIN_WORDS}
           group by line
           having count(distinct source) >= case when max(words) > {LONG_WORDS} then {LONG_SITES} else {MIN_SITES} end),
gone as (select r.doc_id, r.pos from rows r join spread s on r.line = s.line
         where not (r.doc_id = s.first.d and r.pos = s.first.p)),
left_lines as (select p.doc_id, string_agg(p.raw, chr(10) order by p.pos) as clean
               from pieces p anti join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, cast(coalesce(len(d.ls), 0) as bigint) as n_lines, coalesce(c.n, 0) as n_removed,
       sha256(coalesce(l.clean, '')) as clean_sha256
from docs d left join left_lines l on d.doc_id = l.doc_id left join counts c on d.doc_id = c.doc_id"""
