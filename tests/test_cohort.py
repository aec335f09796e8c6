"""Cohorts by turns against a plain pass, split phases, sketches that merge, and win rates."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, results, structure, windows


def by_turns(rows, size, cap, seed):
    groups = defaultdict(list)
    for ref, stratum, template, excluded in rows:
        if not excluded:
            groups["unknown" if stratum is None else stratum].append((hashlib.sha256(f"{seed}\0c\0{ref}".encode()).hexdigest(), ref, template))
    at, used, out, active = Counter(), Counter(), [], sorted(groups)
    for g in groups.values():
        g.sort(key=lambda x: x[:2])
    while active and len(out) < size:
        for s in list(active):
            while at[s] < len(groups[s]):
                _, ref, t = groups[s][at[s]]
                at[s] += 1
                if t is None or cap is None or used[t] < cap:
                    used[t] += 1
                    out.append((ref, s))
                    break
            if at[s] == len(groups[s]):
                active.remove(s)
            if len(out) == size:
                break
    return out


@pytest.mark.parametrize(("size", "cap"), [(10, 2), (200, 1), (25, None), (30, 3)])
def test_cohort(spark, size, cap):
    rng = random.Random(size)
    rows = [(f"r{k:03}", rng.choice(["a", "b", "c", None] + ["hot"] * 4), rng.choice([None, "t1", "t1", "t1", "t2", f"u{k % 9}"]), rng.random() < 0.1) for k in range(150)]
    taken, counts = results.cohort(spark.createDataFrame(rows, "ref string, stratum string, template string, excluded boolean"), size, cap, "seed", "c")
    want = by_turns(rows, size, cap, "seed")
    assert [(r.ref, r.stratum) for r in taken.orderBy("place").collect()] == want
    got = {r.stratum: (r.population, r.eligible, r.selected, r.shortfall) for r in counts.collect()}
    for s in {"unknown" if r[1] is None else r[1] for r in rows}:
        own = [r for r in rows if (r[1] or "unknown") == s]
        assert got[s] == (len(own), sum(not r[3] for r in own), sum(x == s for _, x in want), size - len(want))


def test_split_phases(spark):
    def plain(kinds):
        out, sub, prev = [], 0, None
        for i, k in enumerate(kinds):
            if prev is not None and k is not None and k != prev and i - sub >= 3:
                out.append((sub, i))
                sub = i
            prev = k
        return [(0, len(kinds))] if len(kinds) <= 15 else [*out, (sub, len(kinds))]

    rng, rows, want = random.Random(2), [], set()
    for p in range(12):
        kinds = [rng.choice(["a", "a", "b", None]) for _ in range(rng.choice([3, 15, 16, 40]))]
        rows += [("s", p, i, k) for i, k in enumerate(kinds)]
        want |= {(p, a, b) for a, b in plain(kinds)}
    got = windows.split_phases(spark.createDataFrame(rows, "s string, p int, i int, k string"), ["s", "p"], ["i"], F.col("k"))
    assert {(r.p, r.start, r.stop) for r in got.collect()} == want


def test_sketches_merge(spark):
    df = spark.range(60_000).selectExpr("id % 7 AS day", "CASE WHEN id % 50 = 0 THEN -1.0 ELSE exp(pmod(xxhash64(id), 1000) / 100.0) END AS v", "'k' AS k").union(spark.createDataFrame([(1, None, "k")], "day long, v double, k string"))
    whole, parts = structure.sketches(df, ["k"], "v"), structure.sketches(df, ["k", "day"], "v")
    qs = [0.01, 0.5, 0.9, 0.99]
    a, b = (structure.told(x, ["k"], qs).first() for x in (whole, structure.merged(parts, ["k"])))
    assert a == b and a.n == 60_000
    values = sorted(r.v for r in df.where("v is not null").collect())
    assert abs(a.distinct - len(set(values))) <= 0.05 * len(set(values)) and (a.least, a.most) == (values[0], values[-1])
    for q in qs:
        exact, got = values[-(-len(values) * int(q * 100) // 100) - 1], a[f"p{q * 100:g}"]
        assert got == 0.0 if exact <= 0 else exact / 1.02 <= got <= exact * 1.02


def test_members_are_counted_exactly(spark):
    df = spark.range(40_000).selectExpr("id % 7 AS day", "IF(id % 100 = 0, null, id % 20000) AS v", "'k' AS k")
    stored = structure.members(df, ["k", "day"], "v")
    assert stored.count() == df.where("v is not null").select("day", "v").distinct().count()
    assert [tuple(r) for r in structure.counted(stored, ["k"]).collect()] == [("k", 19_800)]


def test_merged_sketches_at_the_largest_given_size(spark):
    from threadloom.plans import QUERIES

    got = {r.kind: r.users for r in QUERIES["merged_sketches"](spark, "/root/testdata/sf0.1").collect()}
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    assert got == {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).collect()}


def test_win_rates(spark):
    games = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), ("a", "d")], "winner string, loser string")
    assert {r.item: (r.wins, r.games, r.rate) for r in graph.win_rates(games).collect()} == {"a": (3, 4, 0.75), "b": (1, 3, 0.333333), "d": (0, 1, 0.0)}
