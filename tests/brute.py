"""Plain-Python answers for small inputs."""

from __future__ import annotations

import random
from collections import defaultdict


def kmer_set(mates: list[list[str]], k: int) -> set[str]:
    return {run[i : i + k] for mate in mates for run in mate for i in range(len(run) - k + 1)}


def edges(kmers: dict[int, set[str]], m: int) -> set[tuple[int, int, int]]:
    ids = sorted(kmers)
    found = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            weight = len(kmers[a] & kmers[b])
            if weight >= m:
                found.add((a, b, weight))
    return found


def components(pairs) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def neighbor_sets(pairs) -> dict[int, set[int]]:
    around = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    return around


def random_pairs(seed: int, n: int = 30, share: float = 0.08) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]


def greedy(adjacent: dict[int, set[int]], seed_max: int) -> list[tuple[list[int], list[int]]]:
    """Seed groups of one component, straight from the written rule."""
    visited: set[int] = set()
    out = []
    for v in sorted(adjacent):
        if v in visited:
            continue
        seed, rest = [v], []
        visited.add(v)

        def take(x, where):
            where.append(x)
            visited.add(x)

        for x in sorted(adjacent[v]):
            if x not in visited:
                take(x, rest)
        si = ni = 0
        while len(seed) < seed_max:
            if ni < len(rest):
                for x in sorted(adjacent[rest[ni]]):
                    if x not in visited:
                        take(x, rest if any(x in adjacent[s] for s in seed) else seed)
                ni += 1
            elif si < len(seed):
                for x in sorted(adjacent[seed[si]]):
                    if x not in visited:
                        take(x, rest)
                si += 1
            else:
                break
        out.append((seed, rest))
    return out


def check_groups(rows, component_of: dict[int, int], around, seed_cap: int | None) -> None:
    """Assert the group invariants on (group_id, component, group_idx, read_id, is_seed) rows."""
    members = defaultdict(list)
    for row in rows:
        members[row.group_id].append(row)
    ids = [row.read_id for row in rows]
    assert sorted(ids) == sorted(component_of)  # each read in exactly one group
    for group_id, group in members.items():
        comps = {row.component for row in group}
        assert comps == {component_of[row.read_id] for row in group} and len(comps) == 1
        assert group_id == f"{group[0].component}.{group[0].group_idx}"
        seeds = [row.read_id for row in group if row.is_seed]
        assert seeds
        assert all(b not in around[a] for a in seeds for b in seeds)
        assert all(any(s in around[row.read_id] for s in seeds) for row in group if not row.is_seed)
        if seed_cap is not None:
            assert len(seeds) <= seed_cap
