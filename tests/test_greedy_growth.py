"""Greedy growth against the rule written out with sets, and lists from buckets against sets."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqbin.operators import groups
from seqbin.operators.graph import attach_components, component_nodes, connected_components, neighbors
from seqbin.operators.groups import seed_groups


def plain_growth(near: dict[int, list[int]], seed_max: int, strict: bool) -> set[tuple[int, int, bool]]:
    """``(group, read, is_seed)`` of one component."""
    free, found, number = set(near), set(), 0
    for start in sorted(near):
        if start not in free:
            continue
        seeds, others, covered = [start], [r for r in near[start] if r in free], set(near[start])
        free -= {start, *others}
        i = j = 0
        while len(seeds) < seed_max and (i < len(others) or j < len(seeds)):
            if i < len(others):
                for read in near[others[i]]:
                    if read not in free or (read not in covered and strict and len(seeds) >= seed_max):
                        continue
                    (others if read in covered else seeds).append(read)
                    if read not in covered:
                        covered |= set(near[read])
                    free.discard(read)
                i += 1
            else:
                taken = [r for r in near[seeds[j]] if r in free]
                others += taken
                free -= set(taken)
                j += 1
        found |= {(number, r, True) for r in seeds} | {(number, r, False) for r in others}
        number += 1
    return found


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seed_max", [2, 5])
def test_greedy_growth_is_the_plain_rule(spark, strict, seed_max):
    pairs = brute.random_pairs(7, share=0.05)
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    comps = brute.components(pairs)
    want = {}
    for number in set(comps.values()):
        inside = {r: sorted(near[r]) for r in near if comps[r] == number}
        for group, read, is_seed in plain_growth(inside, seed_max, strict):
            want[read] = (number, group, is_seed)
    reads = spark.createDataFrame([(r,) for r in near], "read_id bigint")
    nodes = component_nodes(attach_components(reads, connected_components(edges)), neighbors(edges, max_list=3))
    got = {r.read_id: (r.component, r.group_idx, r.is_seed) for r in seed_groups(nodes, seed_max, strict).collect()}
    assert got == want


def test_growth_of_a_component_that_all_overlap():
    n = 3000
    every = np.arange(n, dtype=np.int64)
    adjacent = {i: np.delete(every, i) for i in range(n)}
    batch = groups._grow_component(7, adjacent, 20, True)
    assert batch.num_rows == n and sum(batch.column("is_seed").to_pylist()) == 1
    assert set(batch.column("read_id").to_pylist()) == set(range(n))


def test_neighbours_are_shuffled_once_as_lists(spark):
    edges = spark.range(1, 500).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    doubled = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = neighbors(doubled.unionByName(spark.sql("select 3L as src, 3L as dst union all select null, 4L")), max_list=100)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "rangepartitioning" not in plan
    rows = {(r.read_id, r.part, r.parts): r.nbrs for r in lists.collect()}
    assert sorted(x for key, r in rows.items() if key[0] == 0 for x in r) == list(range(1, 500))
    assert len([key for key in rows if key[0] == 0]) == 5 and rows[(4, 0, 1)] == [0]
