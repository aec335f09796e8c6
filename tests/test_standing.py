"""Alerts across micro-batches, and stored sets compared from the top down."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import members
from threadloom.scratch import folder
from threadloom.streaming import alerts, appended


def plain(rows, repeat_ms, window_ms, budget):
    out, state = [], {}
    for family, at, level in rows:
        now, told, last, window, used = state.get(family, ("", 0, -1, 0, 0))
        if at < last:
            out.append((family, at, level, "late"))
            continue
        if at // window_ms != window:
            window, used = at // window_ms, 0
        if level == now or (now == "" and level == "ok"):
            what = "quiet" if level == "ok" else "told" if at - told >= repeat_ms else "repeat"
        else:
            what = "told"
        if what == "told" and level != "ok" and used >= budget:
            what = "budget"
        if what == "told":
            now, told, used = level, at, used + (level != "ok")
        state[family] = (now, told, at, window, used)
        out.append((family, at, level, what))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_alerts_hold_over_batches(spark, tmp_path, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", appended.ROCKS)
    rng = random.Random(7)
    times = sorted(rng.sample(range(0, 40_000), 60))
    rows = [(f, t, rng.choice([1.0, 31.0, 60.0, 300.0]), rng.choice([0, 1, 1, 1]), rng.choice([2.0, 10.0, 0.0, 5.0]), rng.choice([10, 100, 100])) for t in times for f in ("x", "y")]
    level = lambda r: "ok" if not (r[3] and r[2] >= 30 and r[5] >= 50 and r[4] > 0) else "error" if r[2] >= 20 * r[4] else "warning" if r[2] >= 5 * r[4] else "ok"
    schema = "family string, at_ms long, lag_s double, stuck int, p95 double, samples int"
    late = [("x", times[3], 300.0, 1, 2.0, 100)]
    size = len(rows) // batches
    for k in range(batches + 1):
        part = rows[k * size : (k + 1) * size] if k < batches else late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        out = alerts.alerts(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), 5000, 10_000, 2)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema(alerts.OUT).parquet(f"file://{tmp_path}/out").collect())
    want = plain([(r[0], r[1], level(r)) for r in [*rows, *late]], 5000, 10_000, 2)
    assert got == sorted(want) and {w[3] for w in want} == {"told", "quiet", "repeat", "budget", "late"}


@pytest.mark.parametrize("listed", [1000, 0])
def test_changes_of_stored_sets(spark, listed):
    path = folder(spark, "sets")
    a = spark.range(20_000).where("id <> 77")
    b = spark.range(20_003).where("id % 9001 <> 0")
    depth = members.store(a, "id", f"{path}/a")
    assert members.store(b.union(b), "id", f"{path}/b", depth) == depth == 3
    got = sorted((r.change, int(r.member)) for r in members.changes(spark, f"{path}/a", f"{path}/b", depth, listed).collect())
    assert got == [("added", 77), ("added", 20_000), ("added", 20_001), ("added", 20_002), ("removed", 0), ("removed", 9001), ("removed", 18_002)]
    assert members.changes(spark, f"{path}/a", f"{path}/a", depth, listed).count() == 0


def test_reads_grow_with_the_difference(spark):
    path = folder(spark, "sets")
    depth = members.store(spark.range(20_000), "id", f"{path}/a")
    members.store(spark.range(1, 20_000), "id", f"{path}/b", depth)
    levels = [x.count() for x in members.differing(spark, f"{path}/a", f"{path}/b", depth)]
    assert levels == [1] * (depth + 1)
    node = members.differing(spark, f"{path}/a", f"{path}/b", depth)[-1].first().node
    assert spark.read.parquet(f"{path}/a/members").where(F.col("h").startswith(node)).count() < 4 * members.RANGE
    assert len(members.differing(spark, f"{path}/a", f"{path}/a", depth)) == 1


def test_baseline_advances_with_a_stream(spark, tmp_path):
    standing, found = members.Standing(spark, f"file://{tmp_path}/standing"), []

    def step(batch, number):
        changed = standing.advance(batch.where("v > 10"), "id", f"b{number}")
        found.append(None if changed is None else sorted((r.change, r.member) for r in changed.collect()))

    for rows in ([(1, 11), (2, 12), (3, 1)], [(2, 12), (3, 13)], [(2, 12), (3, 13)]):
        spark.createDataFrame(rows, "id long, v long").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in").writeStream.foreachBatch(step).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert found == [None, [("added", "3"), ("removed", "1")], []]
    assert standing.advance(spark.range(1), "id", "b1") is None


def test_few_members_and_none(spark):
    path = folder(spark, "sets")
    few = [str(k) for k in range(12)]
    depth = members.store(spark.createDataFrame([(x,) for x in few], "id string"), "id", f"{path}/few")
    members.store(spark.createDataFrame([], "id string"), "id", f"{path}/none", depth)
    assert sorted(r.member for r in members.changes(spark, f"{path}/none", f"{path}/few", depth).collect()) == sorted(few)
    assert {r.change for r in members.changes(spark, f"{path}/few", f"{path}/none", depth).collect()} == {"removed"}
