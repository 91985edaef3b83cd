"""The pipeline stage by stage against a plain version, on the smallest tables."""

import hashlib

import corpus_pipeline
import duckdb
import pytest

from seqbin.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def _near_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR).cache()
        seen[name] = docs
        if name != "encode":
            assert docs.columns == columns
    texts = {n: {r.doc_id: r.text for r in d.collect()} for n, d in seen.items() if n != "encode"}

    # lines: the same rule in SQL over the rows of the stage before
    con = duckdb.connect()
    before = seen["toxicity"].toPandas()
    con.register("documents", before)
    report = con.execute(queries.ORACLES["op10_line_spread"]).fetchall()
    empty = hashlib.sha256(b"").hexdigest()
    want = {r[0]: r[3] for r in report if not (r[2] and r[3] == empty)}
    got = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts["line_dedup"].items()}
    assert set(got) <= set(want) and all(got[i] == want[i] for i in got)
    assert {i for i in want if texts["toxicity"][i].strip()} <= set(got)

    # near duplicates: one of each component
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    components = _near_components({i: shingles(t) for i, t in texts["line_dedup"].items()})
    assert set(texts["near_dedup"]) == {i for i, c in components.items() if i == c}

    # benchmark windows
    con.register("documents", seen["near_dedup"].toPandas())
    con.execute(f"create view benchmark as select * from '{SF_DIR}/benchmark.parquet'")
    hits = {r[0] for r in con.execute(queries.ORACLES["op5_decontaminate"]).fetchall() if r[-1]}
    assert set(texts["decontaminate"]) == set(texts["near_dedup"]) - hits

    # ids decode to the text
    for r in seen["encode"].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts["decontaminate"][r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 100 and "ids" in rows.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = queries.QUERIES[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
