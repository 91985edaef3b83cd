"""Secrets in texts, with weak candidates linked to the parts that complete them.

A credential comes in parts: an access identifier, a secret, an endpoint. Three
base kinds are reported on their own. Weak candidates (a random-looking token, a
host or address, a user name) prove nothing alone; they are reported only when the
parts that complete them stand within ``SCOPE`` characters. That is an interval
join inside each document: positions are cut into cells as wide as the scope, each
cell keeps the outermost part of every role, and a candidate looks at its own and
the two neighbouring cells. Only parts are shuffled, never texts, and a cell with
thousands of parts is still one row.

Linking rules: a weak token needs an identifier; a user name needs a secret (base
or linked token); an endpoint needs both an identifier and a secret.

Defined cases: a null or empty text has no spans (digest of nothing); long texts are scanned
whole, and a value of any length is one span; a null doc_id, or rows that repeat one, are
scanned like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbin.staging import stage

#: characters between a candidate and the part that completes it
SCOPE = 200

# fixed values: the base kinds, in the order in which they are listed
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token", "user", "endpoint")

# the weak kinds, of any length; a host has labels of at most 63 characters and at most 127 of them
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
USER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name|_?id)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9])(?:https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}|(?:[a-z0-9-]{1,63}\.){2,126}(?:com|net|org|io|internal)(?![A-Za-z0-9]))"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, by start and kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of weak candidates; a token must mix letters and digits."""
    found = []
    for m in TOKEN.finditer(text):
        word = m.group()
        if re.search(r"[0-9]", word) and re.search(r"[A-Za-z]", word):
            found.append((m.start(), 3, m.end()))
    found += [(m.start(), 4, m.end()) for m in USER.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return found


def _outside(weak, base):
    """Weak spans that do not lie within a base span (sorted by start)."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    return [w for w in weak if (at := bisect_right(starts, w[0])) == 0 or ends[at - 1] < w[2]]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def extract_parts(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_assign, n_access, n_hex, base_sha256, parts)`` per row.

    ``parts`` holds base and weak spans; weak ones only where the document has a
    base span at all (nothing else could complete them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            counts, shas, parts = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [s[1] for s in base]
                counts.append([kinds.count(k) for k in range(3)])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                weak = _outside(weak_spans(text), base) if base else []
                parts.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base + weak])
            yield pa.record_batch(
                [batch.column(0), batch.column(1)]
                + [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                + [pa.array(shas, pa.string()), pa.array(parts, pa.list_(span))],
                names=["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "parts"],
            )

    schema = (
        "row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string,"
        " parts array<struct<start int, kind int, end int>>"
    )
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, schema)


def _near(candidates: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The candidates ``(row, start, kind, end)`` with some part within ``scope``.

    Every part enters the cells it touches; a cell keeps the first start and the
    last end. A part in the same cell counts by its distance like any other: the
    cell is exactly as wide as the scope, so it is always near enough.
    """
    cells = (
        parts.select("row", "start", "end", F.explode(_cells("start", "end", scope)).alias("cell"))
        .groupBy("row", "cell")
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    looks = F.sequence(
        F.floor(F.col("start") / scope).cast("long") - 1, F.floor((F.col("end") - 1) / scope).cast("long") + 1
    )
    inside = (F.col("first") - F.col("end") <= scope) & (F.col("start") - F.col("last") <= scope)
    return (
        candidates.withColumn("cell", F.explode(looks))
        .join(cells, ["row", "cell"])
        .filter(inside)
        .select("row", "start", "kind", "end")
        .distinct()
    )


def _cells(start: str, end: str, scope: int):
    return F.sequence(F.floor(F.col(start) / scope).cast("long"), F.floor((F.col(end) - 1) / scope).cast("long"))


def linked_candidates(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(row, start, kind, end)``: weak candidates whose complementary parts are in scope."""
    base = spans.filter("kind <= 2")
    identifiers = spans.filter("kind = 1")
    tokens = _near(spans.filter("kind = 3"), identifiers, scope)
    secrets = base.filter("kind in (0, 2)").select("row", "start", "kind", "end").unionByName(tokens)
    users = _near(spans.filter("kind = 4"), secrets, scope)
    owners = identifiers.select("row", "start", "kind", "end").unionByName(users)
    endpoints = _near(_near(spans.filter("kind = 5"), secrets, scope), owners, scope)
    return tokens.unionByName(users).unionByName(endpoints)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` per row of ``(doc_id, text)``.

    ``spans`` lists base spans and linked candidates as ``kind:start:end`` by start,
    then kind; offsets are code points, ends exclusive. ``base_sha256`` covers the
    base spans alone. A null or empty text has no spans. Rows are told apart even
    if they repeat a doc_id.
    """
    parts = stage(extract_parts(docs), "secret-parts")
    spans = stage(
        parts.filter("size(parts) > 0").select("row", F.inline("parts")).select("row", "start", "kind", "end"), "spans"
    )
    added = linked_candidates(spans, scope).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added")
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    span = "array<struct<start int, kind int, end int>>"
    shown = F.array_sort(F.concat(F.filter("parts", lambda s: s["kind"] <= 2), F.coalesce("added", F.array().cast(span))))
    text = F.array_join(
        F.transform(
            shown,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return parts.join(added, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans")
    )
