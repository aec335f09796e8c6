"""Ancestry walks, intervals, content functions and JSON keys on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import content
from threadloom.operators import judgement, reports, structure


def test_ancestry(spark):
    nodes = [("r", "ok", 1, "v1", "f", True), ("a", "ok", 2, "v1", "f", True), ("b", "stale", 1, "v2", "g", True), ("c", "ok", 1, "v1", "f", True), ("d", "ok", None, None, None, False), ("s", "ok", 1, "v1", "f", True), ("t", "ok", 1, "v1", "f", True)]
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "gone"), ("c", "a"), ("s", "d"), ("t", "s2"), ("a", "a2")]
    nodes += [("a2", "ok", 1, "v1", "f", True), ("s2", "ok", 1, "v1", "f", True)]
    n = spark.createDataFrame(nodes, "node string, state string, epoch int, version string, frame string, complete boolean")
    flags, status = judgement.ancestry(spark.createDataFrame([("r",), ("s",), ("t",)], "node string"), n, spark.createDataFrame(edges, "a string, b string"))
    got = {(r.root, r.node, r.kind): r.path for r in flags.collect()}
    assert got == {
        ("r", "a", "epoch-skew"): ["r", "a"], ("r", "a", "circular-ancestry"): ["r", "a"], ("r", "c", "circular-ancestry"): ["r", "a", "c"], ("r", "b", "stale-ref"): ["r", "b"],
        ("r", "b", "definition-incompatible"): ["r", "b"], ("r", "b", "frame-coverage-drift"): ["r", "b"], ("r", "gone", "missing-ref"): ["r", "a", "c", "gone"], ("s", "d", "frame-coverage-drift"): ["s", "d"],
    }
    assert {r.root: r.status for r in status.collect()} == {"r": "blocked", "s": "flagged", "t": "clean"}


def test_nodes_on_cycles(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 1), (5, 8), (7, 7)]
    assert sorted(r.node for r in judgement.on_cycles(spark.createDataFrame(edges, "a long, b long")).collect()) == [1, 2, 4, 5, 7]


def test_intervals(spark):
    rows = [("one", 5.0, 0)] + [("many", float(v), k) for k, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8] * 25)] + [("none", None, 3)]
    got = {r.k: r for r in judgement.bootstrap(spark.createDataFrame(rows, "k string, v double, i int"), "k", "v", "i", resamples=400).collect()}
    assert got["one"].lo is None and got["one"].mean == 5.0 and set(got) == {"one", "many"}
    assert 4.0 < got["many"].lo < got["many"].mean == 4.5 < got["many"].hi < 5.0  # the standard error is 0.16


def test_paths_repositories_and_times(spark):
    texts = ["`/a/b.py:12`", "src/x.RS,", "no path", "https://x/y.py", "README.md", "'~/n'", "word", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", content.clean_path(F.col("t")))
    got = {r.k: (r.p, r.like, r.lang) for r in df.select("k", "p", content.path_like(F.col("p")).alias("like"), content.language_of(F.col("p")).alias("lang")).collect()}
    assert got == {0: ("/a/b.py", True, "python"), 1: ("src/x.RS", True, "rust"), 2: ("no path", False, None), 3: ("https://x/y.py", False, "python"), 4: ("README.md", True, "markdown"), 5: ("~/n", True, None), 6: ("word", False, None), 7: (None, False, None)}
    remotes = {"git@h:a/b.git": "b", "https://h/a/c/": "c", "ssh://git@h/a/d.git?x=1": "d", "own/er": "er", ".hid/x": None, "word": None, "https://h/": None}
    df = spark.createDataFrame([(k,) for k in remotes], "r string")
    assert {r.r: r.n for r in df.select("r", content.repo_name(F.col("r")).alias("n")).collect()} == remotes
    times = {"86400": dt.datetime(1970, 1, 2), "2025": None, "1700000000.5": dt.datetime(2023, 11, 14, 22, 13, 20, 500000), "2024-01-02T03:04:05Z": dt.datetime(2024, 1, 2, 3, 4, 5), "2024-01-02": dt.datetime(2024, 1, 2), "{x}": None, "soon": None}
    df = spark.createDataFrame([(k,) for k in times], "t string")
    assert {r.t: r.m for r in df.select("t", content.moment(F.col("t")).cast("timestamp_ntz").alias("m")).collect()} == times
    weeks = {"2024-12-30": "2025-W01", "2024-12": "2024-12", "someday": "someday", "": "undated"}
    df = spark.createDataFrame([(k,) for k in weeks], "t string")
    assert {r.t: r.w for r in df.select("t", content.week_of(F.col("t")).alias("w")).collect()} == weeks


def test_languages_of_code(spark):
    code = {"def f(x):\n    import os": "python", "SELECT a FROM b": "sql", "fn main() { let mut x = 1; }": "rust", "plain words": None}
    df = spark.createDataFrame([(k,) for k in code], "t string")
    assert {r.t: r.l for r in df.select("t", content.code_language(F.col("t")).alias("l")).collect()} == code


def test_id_prefixes(spark):
    s = spark.createDataFrame([("ab1",), ("ab2",), ("c",), ("cd",)], "session_id string")
    at = lambda p: [r.session_id for r in reports.by_id_prefix(s, p).collect()]
    assert at("ab") == [] and at("ab1") == ["ab1"] and at("c") == ["c"] and at("cd") == ["cd"] and at("x") == []


def test_keys_that_are_data(spark):
    rows = [(1, f"$.m.k{k}", "STRING", "v") for k in range(5)] + [(1, "$.u.0123456789abcdef01", "STRING", "v"), (1, "$.n", "STRING", "v")]
    got = {r.path for r in structure.collapsed(spark.createDataFrame(rows, "id int, path string, type string, value string"), most=4).collect()}
    assert got == {"$.m.*", "$.u.*", "$.n"}


def test_made_up_records(spark):
    import json

    rows = [(k, "$.a", "STRING", f"v{k % 3}") for k in range(100)] + [(k, "$.b.c", "BIGINT", str(k)) for k in range(50)] + [(1, "$.b", "OBJECT<c: BIGINT>", "{}"), (1, "$.l[]", "BIGINT", "1")]
    flat = spark.createDataFrame(rows, "id int, path string, type string, value string")
    got = {r.id: json.loads(r.json) for r in structure.synthetic(flat, 400, 5).collect()}
    assert set(got) == set(range(400)) and {x["a"] for x in got.values()} == {"v0", "v1", "v2"}
    assert set().union(*got.values()) == {"a", "b.c"} and 140 < sum("b.c" in x for x in got.values()) < 260
    assert got == {r.id: json.loads(r.json) for r in structure.synthetic(flat, 400, 5).collect()}
