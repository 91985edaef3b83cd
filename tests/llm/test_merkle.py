"""The Merkle manifest against a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest

from seqbin.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, digest string, path string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def _path(levels, at):
    """Sibling before, sibling after, for each level below the top."""
    steps = []
    for nodes in levels[:-1]:
        first = at - at % 2
        steps.append((nodes[first:at], nodes[at + 1 : first + 2]))
        at //= 2
    return steps


def brute(rows):
    languages = {}
    for row in rows:
        languages.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row[:5]), row))
    names = sorted(languages, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        languages[name].sort(key=lambda leaf: leaf[:3])
        trees[name] = _levels([leaf[2] for leaf in languages[name]])
    upper = _levels([trees[name][-1][0] for name in names]) if names else []
    out, copies = [], []
    for number, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(languages[name]):
            steps = _path(trees[name], at) + _path(upper, number)
            changed = leaf
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            if tampered and row[3] is not None:
                changed = _leaf((*row[:3], row[3] + 1, row[4]))
            nodes = [changed]
            for left, right in steps:
                nodes.append(_h(*left, nodes[-1], *right))
            root = upper[-1][0]
            proof = _h(*(d for step in steps for side in step for d in side))
            out.append((row[0], leaf, trees[name][-1][0], root, proof, nodes[-1], nodes[-1] == root))
            if tampered:
                copies.append((row[0], tuple(nodes)))
    return out, copies


def _key(row):
    return tuple(str(v) for v in row)


def _rows(sizes):
    rows, i = [], 0
    for lang, n in sizes:
        for _ in range(n):
            text = None if i % 11 == 3 else "" if i % 13 == 2 else f"täxt {i} " * (i % 5)
            rows.append((i * 3 % 1009, None if i % 9 == 4 else f"s{i % 3}", lang, None if i % 8 == 5 else len(text or ""), text))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 5)], [("en", 64), (None, 1), ("de", 17), ("é", 4), ("Z", 33)], [("a", 130), ("b", 2)]])
def test_proofs_and_versions(spark, sizes):
    rows = _rows(sizes)
    docs = spark.createDataFrame([r + (None, None, None) for r in rows], SCHEMA).repartition(5)
    want, copies = brute(rows)
    got = merkle.manifest_proofs(docs, bits=2)
    assert sorted(map(_key, got.collect())) == sorted(map(_key, want))
    assert sorted(map(_key, merkle.manifest_proofs(docs).collect())) == sorted(map(_key, want))
    versions = [(r.doc_id, tuple(r.nodes)) for r in merkle.manifest_versions(docs, bits=3).collect()]
    assert sorted(versions) == sorted(copies)


def test_many_languages(spark):
    rows = _rows([(f"l{i}", 1 + i % 3) for i in range(23)])
    docs = spark.createDataFrame([r + (None, None, None) for r in rows], SCHEMA)
    assert sorted(map(_key, merkle.manifest_proofs(docs, bits=1).collect())) == sorted(map(_key, brute(rows)[0]))


def test_nulls_repeated_rows_long_texts_and_empty_tables(spark):
    long = "wört " * 100_000
    rows = [(None, None, None, None, None), (7, "s", "en", 3, "abc"), (7, "s", "en", 3, "abc"), (7, "s", "en", None, long),
            (None, "s", "en", 0, ""), (1, None, None, 1, "x"), (2**40, "s", "en", 5, "y")]
    docs = spark.createDataFrame([r + (1, "d", "p") for r in rows], SCHEMA)
    got = merkle.manifest_proofs(docs, bits=1)
    assert sorted(map(_key, got.collect())) == sorted(map(_key, brute(rows)[0]))
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest_proofs(empty).collect() == [] and merkle.manifest_versions(empty).collect() == []
    assert merkle.manifest_proofs(empty).columns == got.columns


def test_untampered_documents_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    for row in merkle.manifest_proofs(docs, bits=4).collect():
        assert row.verified == (zlib.crc32(str(row.doc_id).encode()) % 7 != 0)
