from __future__ import annotations

import random

import pytest

from bytegrove.operators.closure import circles, closure
from bytegrove.operators.hierarchy import Hierarchy


def brute(parent: dict[str, str]) -> dict[str, tuple]:
    """node: (root, path, status, cycle_name) by walking."""
    ring_of: dict[str, list[str]] = {}
    for n in parent:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            for r in ring:
                ring_of[r] = ring
    out = {}
    for n in {*parent, *parent.values()}:
        if n in ring_of:
            out[n] = (None, [n], "cycle", min(ring_of[n]))
            continue
        path = [n]
        while path[-1] in parent and path[-1] not in ring_of:
            path.append(parent[path[-1]])
        end = path[-1]
        out[n] = (None, path, "into_cycle", min(ring_of[end])) if end in ring_of else (end, path, "tree", None)
    return out


def check(spark, parent: dict[str, str]) -> None:
    rows = [(a, b, 1) for a, b in parent.items()] * 2 + [(None, "x", 0), ("y", None, 0)]
    h = Hierarchy(spark.createDataFrame(rows, "child string, parent string, node int"))
    want = brute(parent)
    got = {r.node: (r.root, list(r.path), r.status, r.cycle_name) for r in h.nodes().collect()}
    assert got == want
    assert all(r.depth == len(r.path) - 1 for r in h.nodes().collect())
    assert {(r.node, r.cycle_name) for r in h.cycles().collect()} == {(n, v[3]) for n, v in want.items() if v[2] == "cycle"}
    pairs = {(a, n, i) for n, v in want.items() for i, a in enumerate(v[1]) if i}
    assert {tuple(r) for r in h.descendants().collect()} == pairs


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_circles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    parent = {n: rng.choice(names) for n in names[: 36 - seed]}
    check(spark, parent)


def test_chain_star_and_self_circle(spark):
    chain = {f"c{i:03d}": f"c{i + 1:03d}" for i in range(70)}
    star = {f"s{i:03d}": "hub" for i in range(200)}
    check(spark, chain | star | {"hub": "c000", "self": "self", "a": "b", "b": "c", "c": "a", "t": "a"})


def test_empty_and_several_parents(spark):
    none = spark.createDataFrame([], "child string, parent string")
    h = Hierarchy(none)
    assert h.cycles().count() == h.nodes().count() == h.descendants().count() == 0
    two = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "b")], "child string, parent string")
    assert [(r.node, r.root) for r in Hierarchy(two).nodes().where("node = 'a'").collect()] == [("a", "b")]
    assert {tuple(r) for r in Hierarchy(two).descendants().collect()} == {("b", "a", 1), ("z", "a", 1)}


def bfs(edges: set[tuple[str, str]]) -> set[tuple[str, str, int]]:
    out = set()
    for root in {a for a, _ in edges}:
        depth, level, seen = 0, {root}, set()
        while level:
            depth += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            out |= {(root, n, depth) for n in level}
    return out


def test_closures_agree_with_search(spark):
    rng = random.Random(5)
    edges = {(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for _ in range(22)}
    df = spark.createDataFrame([*edges, *edges, (None, "v1"), ("v1", None)], "src string, dst string")
    assert {tuple(r) for r in closure(df).collect()} == bfs(edges)
    seeds = spark.createDataFrame([("v1",), ("v2",)], "root string")
    assert {tuple(r) for r in closure(df, seeds).collect()} == {x for x in bfs(edges) if x[0] in ("v1", "v2")}
    assert closure(df.limit(0)).isEmpty()


def test_links_with_several_parents(spark):
    """Links that the smallest parent hides: ancestors through the larger one, and a circle through it."""
    links = [("C", "A"), ("C", "B"), ("B", "R"), ("D", "C"), ("X", "Aa"), ("X", "Z"), ("Z", "X"), ("S", "S")]
    df = spark.createDataFrame(links, "child string, parent string")
    h = Hierarchy(df)
    assert {tuple(r) for r in h.cycles().collect()} == {("X", "X"), ("Z", "X"), ("S", "S")}
    assert {(r.descendant, r.node, r.distance) for r in h.descendants().collect()} == bfs(set(links))


def test_circles_that_share_nodes(spark):
    rng = random.Random(8)
    edges = {(f"v{rng.randrange(25):02d}", f"v{rng.randrange(25):02d}") for _ in range(32)}
    reach = {(a, b) for a, b, _ in bfs(edges)}
    want = {(a, min(b for b in {x for p in reach for x in p} if (a, b) in reach and (b, a) in reach)) for a, b in reach if a == b}
    assert {tuple(r) for r in circles(spark.createDataFrame(list(edges), "child string, parent string")).collect()} == want
