"""Strong components against a plain search, and the number of rounds on long chains."""

import random

import pytest

from threadloom.operators import graph


def brute(edges):
    nodes = sorted({x for e in edges for x in e})
    onward = {n: [b for a, b in edges if a == n] for n in nodes}

    def reach(n):
        seen, stack = set(), list(onward[n])
        while stack:
            if (x := stack.pop()) not in seen:
                seen.add(x)
                stack += onward[x]
        return seen

    of = {n: reach(n) for n in nodes}
    return {n: min(m for m in nodes if m in of[n] and n in of[m]) for n in nodes if n in of[n]}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((30, 45, 60, 90)[seed])] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(3, 200), (200, 201), (201, 202), (202, 3), (5, 5), (None, 1), (300, 300)]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute([e for e in edges if e[0] is not None])


@pytest.mark.parametrize("ring", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, ring):
    n, kept = 10_000, []
    keep = graph._keep
    monkeypatch.setattr(graph, "_keep", lambda df, path: kept.append(path) or keep(df, path))
    edges = spark.range(n).selectExpr("id AS a", f"IF(id = {n - 1}, {0 if ring else n}, id + 1) AS b")
    got = graph.strong_components(edges)
    assert got.count() == (n if ring else 0) and len(kept) < 40
    if ring:
        assert got.select("component").distinct().collect()[0].component == 0


def test_core_holds_edges_between_two_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")], "a string, b string")
    assert sorted(map(tuple, graph.cyclic_core(edges).collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]
    assert graph.cyclic_core(edges.limit(0)).count() == 0
