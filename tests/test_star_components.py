"""Stars of an edge table: the first independent set, and components told from stars."""

import random
from collections import Counter

import pytest

from seqbin.operators import groups
from seqbin.operators.graph import attach_components, connected_components
from seqbin.operators.groups import first_stars, independent_ends, star_components
from seqbin.staging import stage


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def hashes(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").selectExpr("id", "xxhash64(id) h").collect()
    return {r["id"]: r["h"] for r in rows}


def first_set(pairs, order):
    """Every read and its smallest seed, going through the reads by hash."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = set()
    for read in sorted(near, key=order.get):
        if not near[read] & seeds:
            seeds.add(read)
    return {r: r if r in seeds else min(near[r] & seeds) for r in near}


@pytest.mark.parametrize("n, e", [(40, 25), (40, 60), (30, 200)])
def test_independent_ends_is_the_first_set(spark, n, e):
    draw = random.Random(n + e)
    pairs = [(draw.randrange(n) * 1000, draw.randrange(n) * 1000) for _ in range(e)]
    pairs += [(b, a) for a, b in pairs[:5]]
    got = {r["read_id"]: r["seed"] for r in independent_ends(edge_table(spark, pairs)).collect()}
    assert got == first_set(pairs, hashes(spark, {x for p in pairs for x in p}))


def test_no_copy_of_the_edges_is_written(spark, monkeypatch):
    pairs = [(i, j) for i in range(50) for j in range(i)]
    written = []

    def counted(df, name):
        table = stage(df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(groups, "stage", counted)
    edges = stage(edge_table(spark, pairs), "edges")
    assert independent_ends(edges).filter("seed = read_id").count() == 1
    assert sum(written) < len(pairs)


@pytest.mark.parametrize("e", [0, 30, 70])
def test_components_from_stars_equal_those_of_the_edges(spark, e):
    draw = random.Random(e)
    pairs = [tuple(sorted(draw.sample(range(60), 2))) for _ in range(e)]
    edges = stage(edge_table(spark, pairs).distinct(), "edges")
    # reads without edges, one that comes twice, one without an id
    ids = spark.createDataFrame([(i,) for i in [*range(62), 5, 61, None]], "read_id bigint")
    got = star_components(ids, *first_stars(edges))
    assert got.columns == ["read_id", "component"]
    want = attach_components(ids, connected_components(edges))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert Counter(map(tuple, connected_components(edges, table=True).collect())) == Counter(
        map(tuple, connected_components(edges).collect())
    )
