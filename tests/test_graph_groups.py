import random

import brute
import pytest

from seqbin.operators.graph import (
    attach_components,
    component_nodes,
    connected_components,
    neighbors,
    vertices,
)
from seqbin.operators.groups import (
    discard_small,
    group_members,
    group_reads,
    seed_groups,
    seed_groups_rounds,
)
from seqbin.staging import stage


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def as_map(df):
    return {r.read_id: r.component for r in df.collect()}


def test_components_of_random_graphs(spark):
    pairs = brute.random_pairs(1, share=0.05)
    for partitions in (1, 4, 13):
        got = as_map(connected_components(edge_table(spark, pairs).repartition(partitions)))
        assert got == brute.components(pairs)


def test_no_edges(spark):
    none = edge_table(spark, [])
    assert connected_components(none).count() == 0
    reads = spark.range(3).withColumnRenamed("id", "read_id")
    assert as_map(attach_components(reads, connected_components(none))) == {0: 0, 1: 1, 2: 2}
    rows = seed_groups_rounds(none, attach_components(reads, connected_components(none))).collect()
    assert sorted(r.group_id for r in rows) == ["0.0", "1.0", "2.0"]


@pytest.mark.parametrize("shuffled", [True, False])
def test_long_chain_needs_few_rounds(spark, shuffled):
    ids = list(range(2000))
    if shuffled:
        random.Random(5).shuffle(ids)
    rounds = []
    got = as_map(connected_components(edge_table(spark, list(zip(ids, ids[1:]))), lambda r, n: rounds.append(n)))
    assert len(rounds) <= 20 and len(got) == 2000 and set(got.values()) == {0}


def test_vertices_neighbors_nodes(spark):
    edges = edge_table(spark, [(1, 2), (1, 3), (1, 4), (5, 6)])
    reads = spark.range(1, 8).withColumnRenamed("id", "read_id")
    assert {r.read_id for r in vertices(edges).collect()} == {1, 2, 3, 4, 5, 6}
    assert vertices(edges, reads, drop_isolated=False).count() == 7
    assert {r.read_id: r.nbrs for r in neighbors(edges).collect()}[1] == [2, 3, 4]
    hub = edge_table(spark, [(0, i) for i in range(1, 41)])
    parts = [r.nbrs for r in neighbors(hub, max_list=8).filter("read_id = 0").collect()]
    assert len(parts) > 1 and sorted(x for p in parts for x in p) == list(range(1, 41))
    nodes = component_nodes(attach_components(reads, connected_components(edges)), neighbors(edges))
    assert {r.read_id: (r.component, r.nbrs) for r in nodes.collect()}[7] == (7, [])


def all_reads(spark, n):
    return spark.range(n).withColumnRenamed("id", "read_id")


@pytest.mark.parametrize("seed,share", [(1, 0.05), (2, 0.2)])
def test_group_invariants(spark, seed, share):
    pairs = brute.random_pairs(seed, share=share)
    around = brute.neighbor_sets(pairs)
    edges = edge_table(spark, pairs)
    comps = stage(attach_components(all_reads(spark, 30), connected_components(edges)), "comps")
    component_of = as_map(comps)
    nodes = component_nodes(comps, neighbors(edges, max_list=3))
    for cap in (1, 3) if seed == 1 else (3,):
        grown = seed_groups(nodes.repartition(5), cap).collect()
        brute.check_groups(grown, component_of, around, None)
        strict = seed_groups(nodes, cap, strict_seed_cap=True).collect()
        brute.check_groups(strict, component_of, around, cap)
        want = set()
        for comp in set(component_of.values()):
            members = {v: around[v] for v, c in component_of.items() if c == comp}
            for i, (seeds, rest) in enumerate(brute.greedy(members, cap)):
                want |= {(f"{comp}.{i}", v, True) for v in seeds} | {(f"{comp}.{i}", v, False) for v in rest}
        assert {(r.group_id, r.read_id, r.is_seed) for r in grown} == want
    rounds = seed_groups_rounds(edges, comps, 3).collect()
    brute.check_groups(rounds, component_of, around, 3)
    chosen = group_reads(edges, comps, 3).collect()
    assert sorted(chosen) == sorted(rounds)
    if seed == 1:
        with pytest.raises(ValueError):
            group_reads(edges, comps, method="other")
    if seed == 2:
        again = seed_groups_rounds(edges.repartition(13), comps.repartition(7), 3).collect()
        assert sorted(again) == sorted(rounds)


def test_clique_and_chain(spark):
    clique = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    chain = [(i, i + 1) for i in range(10, 40)]
    edges = edge_table(spark, clique + chain)
    comps = attach_components(vertices(edges), connected_components(edges))
    rows = seed_groups(component_nodes(comps, neighbors(edges)), 20).collect()
    assert [(r.group_id, r.read_id) for r in rows if r.component == 0 and r.is_seed] == [("0.0", 0)]
    around = brute.neighbor_sets(clique + chain)
    brute.check_groups(seed_groups_rounds(edges, comps, 4).collect(), as_map(comps), around, 4)


def test_discard_and_members(spark):
    rows = [(f"g{n}", 0, 0, 100 * n + i, i == 0) for n in (1, 4, 5, 6) for i in range(n)]
    groups = spark.createDataFrame(rows, "group_id string, component bigint, group_idx int, read_id bigint, is_seed boolean")
    kept = discard_small(groups)
    assert {r.group_id for r in kept.collect()} == {"g5", "g6"}
    lists = {(r.group_id, r.is_seed): r.members for r in group_members(kept).collect()}
    assert lists[("g5", True)] == [500] and lists[("g5", False)] == [501, 502, 503, 504]
    split = group_members(kept, max_list=2).filter("group_id = 'g6' and not is_seed").collect()
    assert len(split) > 1 and sorted(x for r in split for x in r.members) == [601, 602, 603, 604, 605]
