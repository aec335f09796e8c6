"""Lineage of long chains, cycles, and ids beyond the given tables'."""

import duckdb

from threadloom.operators import graph
from threadloom.plans import ORACLES, QUERIES


def chain(spark, n, more=()):
    return spark.createDataFrame([(k, k - 1 if k else None, k) for k in range(n)] + list(more), "node long, parent long, branch long")


def test_roots_of_a_long_chain_and_cycles(spark):
    edges = chain(spark, 200, [(1000, 1001, 0), (1001, 1000, 0), (1002, 1001, 0), (1003, 1003, 0)])
    got = {r.node: (r.root, r.depth) for r in graph.roots(edges).collect()}
    assert got == {k: (0, k) for k in range(200)} | {k: (None, None) for k in range(1000, 1004)}
    assert [tuple(r) for r in graph.threads(edges).collect()] == [(0, 200, 199)]
    assert sorted(map(tuple, graph.descendants(edges, 0).collect())) == [(k, k) for k in range(1, 200)]
    assert graph.roots(edges.limit(0)).count() == 0


def test_ancestors_of_a_long_chain_and_cycles(spark):
    edges = chain(spark, 70, [(1000, 1001, 5), (1001, 1000, 3), (1002, 1001, 9), (1003, 77_000, 1)])
    got = {(r.node, r.ancestor): (r.limit, r.depth) for r in graph.ancestors(edges).collect()}
    want = {(k, j): (j + 1 if j < k else None, k - j) for k in range(70) for j in range(k + 1)}
    want |= {(k, k): (None, 0) for k in range(1000, 1004)} | {(1000, 1001): (5, 1), (1001, 1000): (3, 1), (1002, 1001): (9, 1), (1002, 1000): (3, 2), (1003, 77_000): (1, 1)}
    assert got == want
    assert graph.ancestors(edges, 5).agg({"depth": "max"}).first()[0] == 5


def test_composed_transcripts_of_large_ids(spark, tmp_path):
    ids = [0, 1, 2, 5, 8191, 1 << 12, 1 << 13, (1 << 20) + 5, *[((1 << 20) + 5) >> k for k in range(1, 20)]]
    rows = [(i, t, "user", "x") for i in sorted(set(ids)) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(f"select session_id, from_session, position, role from ({ORACLES['composed_transcripts']})").fetchall()
    assert sorted(map(tuple, QUERIES["composed_transcripts"](spark, str(tmp_path)).collect())) == sorted(want)


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    from threadloom.operators import reports

    plans, keep = [], graph._keep

    def spy(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, path)

    monkeypatch.setattr(graph, "_keep", spy)
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 99), (4, 5), (5, 4)], "node long, parent long")
    counts = reports.topology_counts(edges)
    once = len(plans)
    plans.append(counts._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in counts.collect()] == [(6, 1, 1, 2)]
    graph.lineage_state(edges)
    assert len(plans) == 2 * once + 1  # the counts walk the lineage once
    assert graph.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")).where("component = 1").count() == 3
    assert "SortMergeJoin" in "".join(plans) and "BroadcastHashJoin" not in "".join(plans)
