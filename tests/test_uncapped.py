"""What had a cap: strengths, cycles, JSON depth, lineage states; and one ordering for sequences and next rows."""

import json
import math
import random

from pyspark.sql import functions as F

from threadloom.operators import aggregates, graph, search, structure, windows


def strengths(games, rounds=200, tolerance=1e-9):
    items = sorted({x for g in games for x in g})
    n = {(a, b): sum(g in ((a, b), (b, a)) for g in games) for a in items for b in items if a != b}
    wins, s = {a: sum(g[0] == a for g in games) for a in items}, dict.fromkeys(items, 1.0)
    for _ in range(rounds):
        new = {a: wins[a] / sum(n[a, b] / (s[a] + s[b]) for b in items if b != a) if wins[a] else s[a] for a in items}
        scale = math.exp(sum(map(math.log, new.values())) / len(new))
        new = {a: x / scale for a, x in new.items()}
        done = all(abs(new[a] - s[a]) < tolerance for a in items)
        s = new
        if done:
            break
    return {a: math.log(x) for a, x in s.items()}


def test_strengths_of_several_components(spark):
    rng = random.Random(3)
    first = [tuple(rng.sample("abcde", 2)) for _ in range(40)]
    second = [("v", "w"), ("v", "w"), ("w", "v"), ("v", "u")]  # u never wins
    want = strengths(first) | strengths(second)
    got = {r.item: r for r in graph.bradley_terry(spark.createDataFrame(first + second + [("a", "a")], "winner string, loser string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].strength - want[k]) < 1e-6 for k in want)
    assert {r.component for r in got.values()} == {"a", "u"} and got["u"].games == 1
    fit = graph.ranker_fit(spark.createDataFrame(second, "winner string, loser string"), spark.createDataFrame([("v", "w"), ("x", "v")], "winner string, loser string"))
    assert [(r.item, r.ties, r.n_observations, r.rank) for r in fit.orderBy("rank").collect()] == [("v", 2, 6, 1), ("w", 1, 4, 2), ("u", 0, 1, 3), ("x", 1, 1, 4)]


def test_long_cycles(spark):
    ring = [(k, (k + 1) % 9) for k in range(9)] + [(3, 20), (20, 21)]
    assert [r.members for r in graph.simple_cycles(spark.createDataFrame(ring, "a long, b long")).collect()] == [list(range(9))]
    assert graph.simple_cycles(spark.createDataFrame(ring[:8], "a long, b long")).count() == 0
    assert graph.simple_cycles(spark.createDataFrame(ring, "a long, b long"), most=5).count() == 0


def test_deep_json(spark):
    doc = {"a": {"b": {"c": {"d": {"e": {"f": [1, {"g": None}]}}}}}, "x": "1"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, "5")], "id int, j string")
    got = {(r.path, r.value) for r in structure.flattened(df, "id", "j").collect() if not (r.value or "")[:1] in "{["}
    assert got == {("$.a.b.c.d.e.f[]", "1"), ("$.x", "1")} or got == {("$.a.b.c.d.e.f[]", "1"), ("$.a.b.c.d.e.f[].g", None), ("$.x", "1")}
    assert structure.flattened(df, "id", "j").where("path = '$.a.b.c.d.e.f[].g'").count() == 1
    assert structure.flattened(df.where("id = 3"), "id", "j").count() == 0


def test_lineage_states_and_families(spark):
    rows = [(0, None), (1, 0), (2, 1), (3, 99), (4, 5), (5, 4), (6, 4), (7, None)]
    edges = spark.createDataFrame(rows, "node long, parent long")
    got = {r.node: (r.state, r.complete) for r in graph.lineage_state(edges).collect()}
    assert got == {0: ("rooted", True), 1: ("rooted", True), 2: ("rooted", True), 3: ("missing_parent", False), 4: ("cycle", False), 5: ("cycle", False), 6: ("cycle", False), 7: ("rooted", True)}
    family = lambda x: sorted(r.node for r in graph.family(edges, x).collect())
    assert family(2) == [0, 1, 2] and family(7) == [7] and family(5) == [5] and family(50) == []


def test_nearest_ranks_of_few_and_equal_values(spark):
    rows = [("a", v) for v in (5, 1, 1, 1, 9)] + [("b", None), (None, 2)]
    got = {r.k: (r.p50, r.p95) for r in aggregates.nearest_ranks(spark.createDataFrame(rows, "k string, v int"), "k", "v", [50, 95]).collect()}
    assert got == {"a": (1, 9), None: (2, 2)}
    assert {r.k: r.n for r in aggregates.metrics(spark.createDataFrame(rows, "k string, v int"), "k", "v", [50]).collect()} == {"a": 5, "b": 1, None: 1}


def test_one_ordering_for_all_steps(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), "id")
    plan = windows.in_sequence(df, "k", F.col("id"), [F.col("id") == 1, F.col("id") == 3, F.col("id") == 5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 1 and text.count("Exchange hashpartitioning(k") <= 2 and "Join" not in text
    after = windows.next_where(df, "k", ["id"], F.col("id") % 4 == 0, "id", "next").orderBy("id").collect()
    assert [r.next for r in after] == [4, 4, 4, 4, 8, 8, 8, 8, None, None]


def test_words_of_all_scripts(spark):
    from threadloom.functions import scalars

    df = spark.createDataFrame([("Éa\u0301 naïve über-Äpfel 漢字 x1",)], "t string")
    assert df.select(scalars.terms(F.col("t"))).first()[0] == ["ea", "naive", "uber", "apfel", "漢字", "x1"]
    assert df.select(search.snippet(F.col("t"), "uber", 1, 1)).first()[0] == "naive [uber]-apfel"
