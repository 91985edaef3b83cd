"""Column expressions on DNA text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: longest k-mer whose two-bit packing fits a non-negative bigint
MAX_PACKED_K = 31


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_bases(c: Column | str) -> Column:
    """Upper-case A/C/G/T; every other character becomes N."""
    return F.regexp_replace(F.translate(_col(c), "acgt", "ACGT"), "[^ACGT]", "N")


def clean_runs(c: Column | str) -> Column:
    """The maximal A/C/G/T runs of a sequence, split at every other character."""
    # upper case per run: of a whole text it would turn other letters into bases
    return F.transform(F.regexp_extract_all(_col(c), F.lit("[ACGTacgt]+"), F.lit(0)), F.upper)


def revcomp(c: Column | str) -> Column:
    """Reverse complement; N stays N."""
    return F.reverse(F.translate(_col(c), "ACGTN", "TGCAN"))


def kmers_of(c: Column | str, k: int) -> Column:
    """All substrings of length ``k`` in order; empty when the text is shorter."""
    c = _col(c)
    starts = F.sequence(F.lit(1), F.length(c) - F.lit(k - 1))
    return F.when(
        F.length(c) >= k, F.transform(starts, lambda p: c.substr(p, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


def kmer_key(c: Column | str) -> Column:
    """Lossless bigint code of an A/C/G/T k-mer of up to 31 bases."""
    return F.conv(F.translate(_col(c), "ACGT", "0123"), 4, 10).cast("bigint")


def representative(c: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    c = _col(c)
    return F.least(c, revcomp(c))


def to_sparse(c: Column | str) -> Column:
    """Dense vector -> array of (idx, value) for its non-zero entries."""
    indexed = F.transform(_col(c), lambda x, i: F.struct(i.alias("idx"), x.alias("value")))
    return F.filter(indexed, lambda e: e["value"] != 0.0)


def to_dense(c: Column | str, size: int) -> Column:
    """Array of (idx, value) -> dense vector of ``size`` entries, 0 where absent.

    The entries are sorted once and the gaps between them filled with zeros.
    """
    nothing = F.lit(-1)

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n.cast("int"))

    def fill(entries: Column) -> Column:
        def with_gap(entry: Column, i: Column) -> Column:
            before = F.when(i == 0, nothing).otherwise(F.get(entries, i - 1)["idx"])
            return F.concat(zeros(entry["idx"] - before - 1), F.array(entry["value"]))

        last = F.coalesce(F.get(entries, F.size(entries) - 1)["idx"], nothing)
        return F.concat(F.flatten(F.transform(entries, with_gap)), zeros(F.lit(size - 1) - last))

    # a one-element transform binds the sorted array, so it is not sorted again per entry
    return F.get(F.transform(F.array(F.sort_array(_col(c))), fill), F.lit(0))


def round_scale(c: Column | str, scale: int) -> Column:
    """Round half up to ``scale`` decimals; a negative scale gives the largest double."""
    if scale < 0:
        return F.lit(1.7976931348623157e308)
    return F.round(_col(c).cast("double"), scale)


def render_fasta(raws: Column | str) -> Column:
    """FASTA text of a read from the raw records of its mates."""
    return F.array_join(F.transform(_col(raws), lambda raw: F.concat(F.lit(">"), raw)), "\n")
