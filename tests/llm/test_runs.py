"""Periodic runs against a direct search by definition."""

import hashlib
import random
import re
import zlib

import numpy as np

from seqbin.llm import runs


def brute_runs(words):
    """Every maximal stretch with its smallest period, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= 2 * q:
                found.setdefault((start, end), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None,) * 4
    if found:
        s, length, q = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0]
        best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _texts(rng, count):
    for number in range(count):
        alphabet = "ab" if number % 3 == 0 else "abc" if number % 3 == 1 else "abcdefgh"
        words = []
        while len(words) < rng.randrange(0, 160):
            if rng.random() < 0.3:
                block = rng.choices(alphabet, k=rng.randrange(1, 7))
                words += block * rng.randrange(2, 9)
                words += block[: rng.randrange(0, len(block) + 1)]
            else:
                words += rng.choices(alphabet, k=rng.randrange(1, 9))
        yield words


def test_runs_equal_the_definition():
    rng = random.Random(11)
    texts = list(_texts(rng, 600)) + [["a"] * 300, ["a", "b"] * 100 + ["a"], [], ["x"] * 5, ["x"] * 6, ["y"]]
    words = [[w.encode() for w in text] for text in texts]
    assert runs.text_runs(words) == [brute_runs(text) for text in texts]


def test_suffix_array_equals_sorting():
    rng = random.Random(5)
    for size in (1, 2, 7, 60, 200):
        words = [rng.randrange(3) for _ in range(size)]
        begins = np.zeros(size, np.int64)
        sa, isa, lcp = runs.suffix_array(np.array(words), begins + size)
        assert sa.tolist() == sorted(range(size), key=lambda i: words[i:])
        assert isa[sa].tolist() == list(range(size))
        for k in range(1, size):
            a, b = words[sa[k - 1] :], words[sa[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def test_branching_squares_equal_the_definition():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(2, 60)
        words = np.array([rng.randrange(2) for _ in range(n)])
        ends = np.full(n, n)
        start, period = runs.branching_squares(*runs.suffix_array(words, ends), ends)
        want = {
            (i, d)
            for i in range(n)
            for d in range(1, (n - i) // 2 + 1)
            if (words[i : i + d] == words[i + d : i + 2 * d]).all() and (i + 2 * d == n or words[i + 2 * d] != words[i + d])
        }
        got = list(zip(start.tolist(), period.tolist()))
        assert set(got) == want and len(got) == len(want)


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [brute_row(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 30_000]
    short = docs.filter("length(text) < 30000")
    got = [tuple(r) for r in runs.periodic_runs(short).collect()]
    assert sorted(got) == sorted(want)
    assert sum(1 for r in want if r[1]) > 3


def test_nulls_spaces_long_and_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, start long, runs string"
    long = "word " * 150_000
    wide = " ".join(f"w{i % 1000}" for i in range(150_000))
    odd = "a\x1cb a\x1cb\x0ba\x1cb a\x1cb  a\x1cb "
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \t\n"), (4, odd), (4, odd), (5, "A a " * 4), (8, "b b b b b")]
    docs = spark.createDataFrame([r + (None, None) for r in rows], schema)
    got = [tuple(r) for r in runs.periodic_runs(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(brute_row(*r)) for r in rows)
    big = spark.createDataFrame([(2, long, 0, ""), (3, wide, 0, "")], schema)
    found = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in runs.periodic_runs(big).collect()}
    assert found == {2: (1, 0, 150_000, 1), 3: (1, 0, 150_000, 1000)}
    empty = spark.createDataFrame([], schema)
    assert runs.periodic_runs(empty).collect() == []
    assert runs.collapse_runs(empty).collect() == []
    texts = {r.doc_id: r.text for r in runs.collapse_runs(docs).collect() if r.doc_id != 4}
    assert texts == {None: "a", 1: None, 2: "", 3: " \t\n", 5: "A a", 8: "b b b b b"}
