"""Cases that the driver's tables don't hold, with expected rows written by hand."""

import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import scalars, tools
from threadloom.operators import aggregates, filters, graph, outcomes, results, search, structure, units, windows
from threadloom.sources import records
from threadloom.streaming import incremental


def test_pairing_of_repeated_missing_and_null_ids(spark):
    uses = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (1, "b", 4)], "session_id int, tool_id string, position int")
    results = spark.createDataFrame([(1, "a", 9), (1, "orphan", 8)], "session_id int, tool_id string, position int")
    got = windows.pair_by_rank(uses, results, ["session_id", "tool_id"], ["position"]).select("position", "found", "result_position").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, True, 9), (2, False, None), (3, False, None), (4, False, None)]


def test_result_state(spark):
    grid = [(True, 0, 1), (True, 1, 0), (True, None, None), (True, 1, None), (True, 0, None), (True, None, 0), (False, None, None)]
    df = spark.createDataFrame(grid, "found boolean, e int, x int")
    got = [r[0] for r in df.select(scalars.result_state(F.col("found"), F.col("e"), F.col("x"))).collect()]
    assert got == ["outcome_error", "outcome_success", "outcome_unknown", "outcome_error", "outcome_success", "outcome_success", "no_result"]


def test_paths_weeks_and_folding(spark):
    df = spark.createDataFrame([("/a/b", dt.datetime(2024, 12, 30)), ("/a/bc", None), ("\\a\\b\\c%", None)], "p string, t timestamp")
    got = df.select(scalars.under_path(F.col("p"), "/a/b/"), scalars.week_key(F.col("t")), scalars.fold_stroke(F.lit("Łał"))).collect()
    assert [tuple(r) for r in got] == [(True, "2025-W01", "Lal"), (False, "undated", "Lal"), (True, "undated", "Lal")]


def test_lineage_chain_fork_and_unknown_parent(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 99)], "node int, parent int")
    got = {r.node: (r.root, r.depth) for r in graph.roots(edges).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 2), 5: (99, 1)}


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    got = records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").select("state", "a").collect()
    assert sorted((r.state, r.a or 0) for r in got) == [("invalid", 0), ("ok", 1), ("ok", 2)]
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, v int, s string")
    assert [tuple(r) for r in records.latest(df, "k", "v").collect()] == [(1, 2, "new")]
    records.write_bundle(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).first().rows == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("tumbling").collect())) == sorted(map(str, incremental.tumbling(events).collect()))


def test_rate_limit_keeps_the_first(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(seconds=5)), ("b", t)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.first_in(stream, ["k"]).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.k for r in spark.table("limited").collect()) == ["a", "b"]


def test_composition_over_chain_cycle_and_missing_parent(spark):
    m = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (5, 0), (6, 0), (7, 0)], "session_id long, position long")
    edges = spark.createDataFrame([(1, None, None), (2, 1, 1), (3, 2, 3), (5, 6, 0), (6, 5, 0), (7, 99, 0)], "node long, parent long, branch long")
    got = {}
    for r in graph.composed(m, edges, 6).orderBy("session_id", "position", "from_session").collect():
        got.setdefault(r.session_id, []).append((r.from_session, r.position))
    assert got == {1: [(1, 0), (1, 1), (1, 2)], 2: [(1, 0), (1, 1), (2, 2), (2, 3)], 3: [(1, 0), (1, 1), (2, 2), (2, 3), (3, 4)], 5: [(5, 0), (6, 0)], 6: [(5, 0), (6, 0)], 7: [(7, 0)]}


def test_components_of_chain_self_loop_and_empty(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 7: 7}
    assert graph.components(links.limit(0)).count() == 0


def test_cycles_and_strengths(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "d")], "a string, b string")
    assert sorted(r.members for r in graph.simple_cycles(links).collect()) == [["a", "b"], ["a", "b", "c"]]
    games = spark.createDataFrame([("x", "y")] * 3 + [("y", "x")], "winner string, loser string")
    got = {r.item: r.strength for r in graph.bradley_terry(games).collect()}
    assert abs((got["x"] - got["y"]) - 1.0986122887) < 1e-6  # three wins to one: ln 3
    assert graph.bradley_terry(games.limit(0)).count() == 0


def test_islands_streaks_and_most_common_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)], "k int, at int, s string")
    assert [tuple(r)[:4] for r in windows.islands(df, "k", ["at"], "s").orderBy("k", "run").collect()] == [(1, 0, "a", 2), (1, 1, None, 2), (1, 2, "a", 1), (2, 0, None, 1)]
    runs = spark.createDataFrame([(1, 1, "f", "x"), (1, 2, "-", "x"), (1, 3, "f", "x"), (1, 4, "f", "y"), (1, 5, "ok", "y"), (1, 6, "f", "y")], "k int, at int, o string, s string")
    assert [tuple(r) for r in windows.signature_streaks(runs, "k", ["at"], F.col("o") == "f", F.col("o") == "ok", "s").collect()] == [(1, 2)]
    assert [tuple(r) for r in aggregates.most_common(df, "k", "s").collect()] == [(1, "a", 3)]


def test_digest_ignores_order_and_counts_repeats(spark):
    def digest(rows):
        return aggregates.multiset_digest(spark.createDataFrame([(1, x) for x in rows], "k int, m string"), "k", F.col("m")).first()

    assert digest(["a", "b", None]) == digest(["b", "a"]) != digest(["a", "b", "b"])


def test_bands_reach_over_their_edges(spark):
    t = dt.datetime(2024, 1, 1, 0, 59)
    a = spark.createDataFrame([(1, t), (2, t), (1, None)], "k int, ts timestamp")
    b = spark.createDataFrame([(1, t + dt.timedelta(hours=1)), (1, t - dt.timedelta(hours=1)), (1, t + dt.timedelta(hours=1, seconds=1))], "k int, ts timestamp")
    assert filters.within_band(a, b, "k", "ts", 3600).count() == 2


def test_results_changes_alignment_and_corrections(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {(r.k, r.change) for r in results.changes(results.snapshot(a, "k", str(tmp_path / "set")), b, "k").collect()} == {(1, "removed"), (3, "added")}
    assert {(r.k, r.state) for r in results.aligned(a, b, "k", ["v"]).collect()} == {(1, "left_only"), (2, "changed"), (3, "right_only")}
    fixes = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, at int")
    assert {(r.k, r.v) for r in results.corrected(a, fixes, "k", "v", "at").collect()} == {(1, "new"), (2, "y")}


def test_json_paths_shapes_and_drift(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": null}'), (3, "broken {"), (4, None)]
    flat = structure.flattened(spark.createDataFrame(rows, "id int, j string"), "id", "j", depth=2).where("path not like '%[]'")
    assert sorted({r.path for r in flat.collect()}) == ["$.a", "$.b", "$.b.c"]
    after = flat.where("path <> '$.b.c'").withColumn("type", F.lit("STRING"))
    assert {r.path: r.change for r in structure.drift(flat, after).collect()} == {"$.a": "retyped", "$.b": "retyped", "$.b.c": "removed"}
    assert structure.shapes(flat, "id").count() == 2


def test_phrases(spark):
    df = spark.createDataFrame([("All  rights, reserved",), ("all rights reservedly",), ("overall rights reserved",), (None,)], "t string")
    assert [r[0] for r in df.select(search.phrase(F.col("t"), ["all", "rights", "reserved"])).collect()] == [True, False, False, None]


def test_typed_values(spark):
    df = spark.createDataFrame([("number", '{"v": 4}'), ("text", '{"v": "4"}'), ("true", '{"v": true}'), ("one", '{"v": 1}'), ("null", '{"v": null}'), ("word", '{"v": "null"}'), ("none", "{}"), ("bad", "{"), ("gone", None)], "name string, j string")
    holds = lambda v: sorted(r.name for r in df.where(units.json_value_is(F.col("j"), "$.v", v)).collect())
    assert [holds(v) for v in (4, "4", True, 1, None, "null")] == [["number"], ["text"], ["true"], ["one"], ["null"], ["word"]]


def test_tool_category(spark):
    cases = {("Read", None): "file_read", ("Task", None): "subagent", ("TaskList", None): "agent", ("Bash", " git log"): "git", ("Bash", "gitk"): "shell", ("KillShell", "git x"): "shell", ("x__search_code", None): "search", (None, None): "other", ("", "git "): "other"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "name string, command string, want string")
    assert df.where(~tools.tool_category(F.col("name"), F.col("command")).eqNullSafe(F.col("want"))).count() == 0


def test_call_times(spark):
    rows = [("s", "a", 1, 0, "start"), ("s", "a", 2, 10, "start"), ("s", "a", 3, 14, "end"), ("s", "a", 4, 20, "end"), ("s", "b", 5, 30, "start"), ("s", None, 6, 31, "start"), ("s", "c", 7, 32, "end"), ("s", "d", 8, 1000, "start")]
    df = spark.createDataFrame(rows, "k string, call string, i int, s long, e string").withColumn("ts", F.timestamp_seconds("s"))
    calls = outcomes.call_times(df, "k", "call", ["i"], "ts", F.col("e") == "start", F.col("e") == "end")
    assert [(r.i, r.ms) for r in calls.where("ms is not null").collect()] == [(3, 4000)]
    ends = spark.createDataFrame([("s", 1_000_000_000)], "k string, end_us long")
    assert outcomes.latency_profile(calls, ends, "k").first().asDict() == {"k": "s", "median_ms": 4000, "p90_ms": 4000, "max_ms": 4000, "stuck": 2}


def test_cyclic_core(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (7, 8)], "a int, b int")
    assert sorted(map(tuple, graph.cyclic_core(edges).collect())) == [(2, 3), (3, 2)]
    assert graph.cyclic_core(edges.where("a <> 3")).count() == 0
