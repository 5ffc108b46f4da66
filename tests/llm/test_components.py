import random

import numpy as np
import pytest

from kinweave.llm import components
from kinweave.llm.groups import pairs_of_groups

LINKS = "record_id_l long, record_id_r long, node long"


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        for x in (a, b):
            if x is not None:
                top(x)
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def groups(df, **more):
    return {r["record_id"]: r["group_id"] for r in components.connected_components(df, **more).collect()}


def test_missing_sides_loops_mirrors_and_an_empty_table(table):
    edges = [(5, 3), (3, 5), (3, 5), (5, 9), (7, 7), (8, None), (None, 2), (None, None), (20, 21)]
    df = table([(*e, 1) for e in edges], LINKS)
    assert groups(df) == brute(edges) == {5: 3, 3: 3, 9: 3, 7: 7, 8: 8, 2: 2, 20: 20, 21: 20}
    assert groups(df.limit(0)) == {}
    assert groups(table([(1, None, 1), (4, 4, 1)], LINKS)) == {1: 1, 4: 4}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "ring"])
@pytest.mark.parametrize("bound", [7, 10_000])
def test_equals_brute_force_whatever_a_task_holds(table, kind, bound):
    rng = random.Random(kind)
    edges = {"random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)], "chain": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(120)], "ring": [(i, (i + 1) % 90) for i in range(90)]}[kind]
    df = table([(*e, 0) for e in edges], LINKS)
    assert groups(df, edges_per_task=bound) == brute(edges)


def test_strings(table):
    df = table([("b", "a"), ("b", "c"), ("z", None)], "record_id_l string, record_id_r string")
    assert groups(df) == {"a": "a", "b": "a", "c": "a", "z": "z"}


def test_union_find_keeps_a_forest():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    node, root = components.union_find(a, b, salt=3)
    want = brute(list(zip(a.tolist(), b.tolist(), strict=True)))
    where = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert len({(want[n], r) for n, r in where.items()}) == len(set(want.values()))
    assert all(where[r] == r for r in where.values())


@pytest.mark.parametrize("block", [2, 3, 500])
def test_pairs_of_groups(table, block):
    members = [(i, "g" if i < 11 else f"s{i // 2}") for i in range(20)]
    want = sorted((a, b) for a, g in members for b, h in members if a < b and g == h)
    got = pairs_of_groups(table(members, "record_id long, g string"), "record_id", "g", block)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("kind", ["dense", "chain"])
def test_edges_shrink_every_round(table, monkeypatch, kind):
    rng = random.Random(kind)
    edges = [(a, b) for a in range(70) for b in range(a)] if kind == "dense" else [(i * 37 % 3001, (i + 1) * 37 % 3001) for i in range(3000)]
    rng.shuffle(edges)
    seen, real = [], components._forests

    def counted(part, id_type, salt):
        seen.append(part.count())
        return real(part, id_type, salt)

    monkeypatch.setattr(components, "_forests", counted)
    assert set(groups(table([(*e, 0) for e in edges], LINKS), edges_per_task=100).values()) == {0}
    assert len(seen) > 1 and all(b <= 0.8 * a for a, b in zip(seen, seen[1:], strict=False)), seen
