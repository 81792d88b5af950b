"""Levels and cycles against plain graph searches; deep and wide graphs in few rounds."""

import random
import sys

import pytest

from tallyfold.operators import graph

sys.setrecursionlimit(10_000)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "child long, parent long")


def reach(pairs):
    above = {}
    for c, p in pairs:
        if c != p:
            above.setdefault(c, set()).add(p)
            above.setdefault(p, set())
    out = {}
    for n in above:
        seen, stack = set(), list(above[n])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += above[x]
        out[n] = seen
    return above, out


def brute(pairs):
    """(node, level, cycle) by reachability."""
    above, up = reach(pairs)
    cycle = {n: min(m for m in up[n] if n in up[m]) if n in up[n] else None for n in above}
    unit = {n: n if c is None else c for n, c in cycle.items()}
    parents = {}
    for n in above:
        parents.setdefault(unit[n], set()).update(unit[p] for p in above[n] if unit[p] != unit[n])
    level = {}

    def of(u):
        if u not in level:
            level[u] = max((of(p) + 1 for p in parents[u]), default=0)
        return level[u]

    return sorted((n, of(unit[n]), cycle[n]) for n in above), {n: n in up[n] or any(m in up[m] for m in up[n]) for n in above}


def check(spark, pairs):
    want, blocked = brute(pairs)
    assert sorted(tuple(r) for r in graph.dependency_order(edges_of(spark, pairs)).collect()) == want
    levels = {r.node: (r.level, r.blocked) for r in graph.dependency_levels(edges_of(spark, pairs)).collect()}
    assert levels == {n: (None, True) if blocked[n] else (next(x[1] for x in want if x[0] == n), False) for n in blocked}


SMALL = {
    "a ring alone": [(1, 2), (2, 1)],
    "behind and before one": [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (1, 9)],
    "a chain between two cycles": [(1, 2), (2, 1), (3, 2), (4, 3), (5, 4), (5, 6), (6, 5), (7, 6)],
    "two rings through one node, a self-loop": [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (5, 5)],
    "mixed": [(2, 1), (3, 2), (4, 3), (4, 2), (1, 4), (8, 3), (9, 8), (8, 9), (10, 10), (11, 10)],
    "diamonds in a row": [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 5), (7, 5), (8, 6), (8, 7)],
}


def side_by_side(graphs):
    return [(100 * k + c, 100 * k + p) for k, g in enumerate(graphs) for c, p in g]


def test_many_small_graphs(spark):
    """Those above and random ones, all in one run, since Spark's rounds cost more than their rows."""
    chance = random.Random(8)
    check(spark, side_by_side([*SMALL.values(), *[[(chance.randrange(9), chance.randrange(9)) for _ in range(chance.randrange(5, 16))] for _ in range(8)]]))


def test_empty_and_lonely(spark):
    none = edges_of(spark, [])
    assert graph.dependency_order(none).count() == 0 and graph.dependency_cycles(none).count() == 0
    lonely = spark.createDataFrame([(5,), (6,)], "node long")
    assert sorted(tuple(r) for r in graph.dependency_order(edges_of(spark, [(6, 7)]), lonely).collect()) == [(5, 0, None), (6, 1, None), (7, 0, None)]


@pytest.mark.parametrize("ring", [False, True])
def test_long_chain_in_few_rounds(spark, monkeypatch, ring):
    n, calls, cut = 100_000, [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: calls.append(1) or cut(df))
    edges = spark.range(n).selectExpr("(id * 7919) % 100000 as child", "((id + 1) * 7919) % 100000 as parent")
    if ring:
        out = graph.dependency_cycles(edges)
        assert out.where("cycle = 0").count() == out.count() == n
    else:
        out = graph.dependency_levels(edges.where(f"id < {n - 1}"))
        assert out.where(f"level = {n - 1} - ((node * {pow(7919, -1, 100_000)}) % 100000) and not blocked").count() == n
    assert len(calls) < (100 if ring else 40)


def test_wide_tree(spark):
    """A third of all nodes hang on one node; names are texts."""
    pairs = [(f"n{i}", "hub" if i % 3 == 0 else f"n{i // 2}") for i in range(1, 600)] + [("hub", "n0")]
    got = {r.node: r.level for r in graph.dependency_levels(spark.createDataFrame(pairs, "child string, parent string")).collect()}
    parent, depth = dict(pairs), {}

    def of(x):
        if x not in depth:
            depth[x] = of(parent[x]) + 1 if x in parent else 0
        return depth[x]

    assert got == {x: of(x) for x in {*parent, *parent.values()}}


def test_rounds_send_no_tables_and_keep_their_size(spark, monkeypatch):
    """Ten rounds: no round is planned with a broadcast, nor with size estimates multiplied over the rounds."""
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution()) or cut(df))
    edges = edges_of(spark, [(i, i - k) for i in range(2, 12) for k in (1, 2)])
    assert {r.node: r.level for r in graph.dependency_levels(edges).collect()} == {i: max(0, i - 1) for i in range(12)}
    assert max(len(str(p.optimizedPlan().stats().sizeInBytes())) for p in plans) < 60
    assert not any("Broadcast" in p.executedPlan().toString() for p in plans)
