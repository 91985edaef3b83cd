"""A Merkle manifest of a table, as a persistent tree with one version per tampered leaf.

Every row is a leaf. The leaves of a language form a tree of arity two, their roots form
one tree above them. A level is never gathered: trees are cut into aligned blocks of
``2 ** BLOCK_BITS`` nodes, one task reduces a block to its top node, and the tops are the
nodes of the next step. Steps go with the logarithm of the rows to the base of a block.

The tree is persistent. To change a leaf makes a version that shares all untouched nodes
and copies its ancestors only: first those inside its own block, then one per level in the
steps above, where the shared siblings come down from block to block. A join on a block
has at most ``2 ** BLOCK_BITS`` rows on either side, so no task gathers the versions of
the top nodes.

Defined cases: a null value is ``-``; a null lang is a language of its own and the first; a
null doc_id comes first and is never tampered; rows that repeat a doc_id are leaves of
their own, in the order of their digests; very long texts are hashed in the JVM and go no
further; an empty table has an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbin.operators.indexing import with_group_position
from seqbin.staging import stage

#: a block holds up to two to this power nodes of one tree
BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: tampered are the rows whose crc32(doc_id as text) it divides
TAMPER_EVERY = 7

# a step of a path to the root: which side the sibling stands on, then its digest
ALONE, LEFT, RIGHT = b"-", b"<", b">"
_ENTRY = 65


def _digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode("ascii")


# --- leaves ----------------------------------------------------------------------


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of values as text: ``-`` for null, else byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, lang, digest, changed)``: the leaf of each row, and what tampering makes of it.

    ``changed`` is null for rows that are not tampered. Tampering adds 1 to n_chars; a
    null stays null, and then both digests are equal.
    """
    values = {
        name: F.col(name).cast("long" if name in ("doc_id", "n_chars") else "string").alias(name) for name in FIELDS
    }
    rows = docs.select(*values.values())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    plain = [F.col(name) for name in FIELDS]
    other = [F.col(name) + 1 if name == "n_chars" else F.col(name) for name in FIELDS]
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "lang",
        leaf_digest(plain).alias("digest"),
        F.when(tampered, leaf_digest(other)).alias("changed"),
    )


# --- one block ---------------------------------------------------------------------


def block_height(total: int, bits: int = BLOCK_BITS) -> int:
    """Levels that a block of a tree of ``total`` nodes is reduced by."""
    return min(bits, (total - 1).bit_length())


def block_levels(digests: list[bytes], height: int) -> list[list[bytes]]:
    """All nodes of a block, level by level; the last level is its top node."""
    levels = [digests]
    for _ in range(height):
        last = levels[-1]
        levels.append([_digest(b"".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def block_path(levels: list[list[bytes]], at: int) -> bytes:
    """The siblings from node ``at`` of the lowest level up to the top of its block."""
    path = []
    for nodes in levels[:-1]:
        other = at ^ 1
        if other >= len(nodes):
            path.append(ALONE + b" " * (_ENTRY - 1))
        else:
            path.append((LEFT if other < at else RIGHT) + nodes[other])
        at >>= 1
    return b"".join(path)


def copied_nodes(digest: bytes, path: bytes) -> list[bytes]:
    """The nodes that a version with leaf ``digest`` copies: the leaf, its ancestors, the root."""
    nodes = [digest]
    for at in range(0, len(path), _ENTRY):
        side, other = path[at : at + 1], path[at + 1 : at + _ENTRY]
        last = nodes[-1]
        nodes.append(_digest(last if side == ALONE else other + last if side == LEFT else last + other))
    return nodes


def siblings(path: bytes) -> bytes:
    """The digests of a path, in order, without the levels that have none."""
    return b"".join(path[i + 1 : i + _ENTRY] for i in range(0, len(path), _ENTRY) if path[i : i + 1] != ALONE)


# --- trees of any size ---------------------------------------------------------------

_MEMBER = "struct<position:bigint,digest:binary,id:bigint,changed:binary>"
_BLOCK = ["tree", "block", "total", "members"]


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """``(tree, block, total, members)`` of nodes ``(tree, position, total, digest, id, changed)``."""
    member = F.struct("position", "digest", "id", "changed")
    return nodes.groupBy("tree", F.shiftright("position", bits).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")
    )


def _members(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.StructScalar]]:
    """``(row, members)`` of a batch: the slices of the list column."""
    lists = batch.column(column)
    for row in range(batch.num_rows):
        yield row, lists[row].values


def _tops(blocks: DataFrame, bits: int) -> DataFrame:
    """``(tree, position, total, digest)``: the top node of each block, a node of the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column(2).to_pylist()
            tops = []
            for row, members in _members(batch, 3):
                digests = [d.hex().encode("ascii") for d in members.field("digest").to_pylist()]
                levels = block_levels(digests, block_height(totals[row], bits))
                tops.append(bytes.fromhex(levels[-1][0].decode("ascii")))
            size = 1 << bits
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([-(-t // size) for t in totals], pa.int64()),
                    pa.array(tops, pa.binary()),
                ],
                names=["tree", "position", "total", "digest"],
            )

    return blocks.select(*_BLOCK).mapInArrow(run, "tree long, position long, total long, digest binary")


@dataclass
class Forest:
    """Trees over nodes: the block tables of each step, and ``(tree, step, digest)`` roots."""

    steps: list[DataFrame]
    roots: DataFrame
    bits: int


def build_forest(nodes: DataFrame, bits: int = BLOCK_BITS) -> Forest:
    """Reduce nodes ``(tree, position, total, digest, id, changed)`` to one root per tree.

    ``position`` is dense inside a tree of ``total`` nodes. ``id`` and ``changed`` are carried.
    """
    steps, roots = [], []
    while True:
        blocks = stage(_blocks(nodes, bits), "merkle-blocks")
        tops = stage(_tops(blocks, bits), "merkle-tops")
        done = tops.filter("total = 1").select("tree", F.lit(len(steps)).alias("step"), "digest")
        steps.append(blocks)
        roots.append(done)
        higher = tops.filter("total > 1")
        if higher.isEmpty():
            return Forest(steps, reduce(DataFrame.unionByName, roots), bits)
        nothing = F.lit(None)
        nodes = higher.withColumn("id", nothing.cast("long")).withColumn("changed", nothing.cast("binary"))


_CARRIED = "subroot binary, root binary, path binary"


def _descend(forest: Forest, entering: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """Hand paths down from the roots to the lowest nodes.

    ``entering`` is ``(tree, step, subroot, root, path)`` per tree: the path above its
    root. At every block the members get the siblings inside it, then that path. ``emit``
    turns the members of the lowest blocks into batches of ``schema``.
    """
    bits = forest.bits
    paths: DataFrame | None = None
    for number in reversed(range(len(forest.steps))):
        at_root = entering.filter(F.col("step") == number).select(
            "tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "path"
        )
        above = at_root if paths is None else at_root.unionByName(paths)
        joined = forest.steps[number].join(above, ["tree", "block"]).select(*_BLOCK, "subroot", "root", "path")
        if number == 0:
            return joined.mapInArrow(lambda batches: emit(_with_levels(batches, bits)), schema)
        paths = joined.mapInArrow(lambda batches: _emit_blocks(_with_levels(batches, bits)), f"tree long, block long, {_CARRIED}")
    raise AssertionError("a forest has a step")


def _with_levels(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple]:
    """``(tree, members, levels, subroot, root, path)`` of each block."""
    for batch in batches:
        trees, totals = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        carried = [batch.column(c).to_pylist() for c in (4, 5, 6)]
        for row, members in _members(batch, 3):
            digests = [d.hex().encode("ascii") for d in members.field("digest").to_pylist()]
            levels = block_levels(digests, block_height(totals[row], bits))
            yield trees[row], members, levels, *(c[row] for c in carried)


def _emit_blocks(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Paths of the members of upper blocks, which are the blocks of the step below."""
    for tree, members, levels, subroot, root, path in blocks:
        n = len(members)
        yield pa.record_batch(
            [
                pa.array([tree] * n, pa.int64()),
                members.field("position"),
                pa.array([subroot] * n, pa.binary()),
                pa.array([root] * n, pa.binary()),
                pa.array([block_path(levels, i) + path for i in range(n)], pa.binary()),
            ],
            names=["tree", "block", "subroot", "root", "path"],
        )


def _emit_trees(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Paths of the members of the upper tree, which are the roots of the language trees."""
    for _, members, levels, _, root, path in blocks:
        n = len(members)
        yield pa.record_batch(
            [
                members.field("id"),
                members.field("digest"),
                pa.array([root] * n, pa.binary()),
                pa.array([block_path(levels, i) + path for i in range(n)], pa.binary()),
            ],
            names=["tree", "subroot", "root", "path"],
        )


# --- the manifest -----------------------------------------------------------------


@dataclass
class Manifest:
    """The trees of the languages (named by the number of their first leaf) and the tree above them."""

    languages: Forest
    upper: Forest | None

    def paths(self) -> DataFrame:
        """``(tree, step, subroot, root, path)`` of the root of each language."""
        top = self.upper.roots.select("tree", "step", F.col("digest").alias("root")).withColumns(
            {"subroot": F.lit(None).cast("binary"), "path": F.lit(b"")}
        )
        emitted = _descend(self.upper, top, _emit_trees, f"tree long, {_CARRIED}")
        return emitted.join(self.languages.roots.select("tree", "step"), "tree")


def build_manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> Manifest:
    """The tree of ``(doc_id, source, lang, n_chars, text)``: leaves by lang, doc_id and digest."""
    rows = stage(leaves(docs), "merkle-leaves")
    placed = with_group_position(rows, ["lang"], ["doc_id", "digest", "row"], "tree", "position", "total")
    nodes = placed.select("tree", "position", "total", "digest", F.col("doc_id").alias("id"), "changed")
    languages = build_forest(nodes, bits)
    if languages.roots.isEmpty():
        return Manifest(languages, None)
    one = languages.roots.select(F.lit(0).cast("long").alias("all"), "tree", "digest")
    ordered = with_group_position(one, ["all"], ["tree"], "start", "position", "total")
    upper = ordered.select(
        F.col("all").alias("tree"), "position", "total", "digest", F.col("tree").alias("id"),
        F.lit(None).cast("binary").alias("changed"),
    )
    return Manifest(languages, build_forest(upper, bits))


def _text(digest: bytes) -> str:
    return digest.decode("ascii")


def _emit_proofs(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for _, members, levels, subroot, root, path in blocks:
        changed = members.field("changed").to_pylist()
        proofs, folded = [], []
        for i, other in enumerate(changed):
            whole = block_path(levels, i) + path
            leaf = levels[0][i] if other is None else other.hex().encode("ascii")
            proofs.append(_text(_digest(siblings(whole))))
            folded.append(_text(copied_nodes(leaf, whole)[-1]))
        n, top = len(changed), root.hex()
        yield pa.record_batch(
            [
                members.field("id"),
                pa.array(list(map(_text, levels[0]))),
                pa.array([subroot.hex()] * n),
                pa.array([top] * n),
                pa.array(proofs),
                pa.array(folded),
                pa.array([f == top for f in folded]),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def _emit_versions(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for _, members, levels, _, _, path in blocks:
        ids, nodes = [], []
        for i, (doc, other) in enumerate(zip(members.field("id").to_pylist(), members.field("changed").to_pylist())):
            if other is not None:
                ids.append(doc)
                nodes.append(list(map(_text, copied_nodes(other.hex().encode("ascii"), block_path(levels, i) + path))))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.string()))], names=["doc_id", "nodes"])


def _over_leaves(docs: DataFrame, emit: Callable, schema: str, bits: int) -> DataFrame:
    manifest = build_manifest(docs, bits)
    if manifest.upper is None:
        return docs.sparkSession.createDataFrame([], schema)
    return _descend(manifest.languages, manifest.paths(), emit, schema)


def manifest_versions(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(doc_id, nodes)`` per tampered leaf: the nodes its version copies, from leaf to root.

    All other nodes of a version are those of the untampered tree.
    """
    return _over_leaves(docs, _emit_versions, "doc_id long, nodes array<string>", bits)


def manifest_proofs(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row.

    ``folded_root`` is recomputed from the tampered leaf, else the original one, and the
    original siblings; ``verified`` tells whether it is the root.
    """
    schema = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return _over_leaves(docs, _emit_proofs, schema, bits)
