"""Calls without ids in a queue, and who answers whom."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import outcomes


def queue(events):
    """Durations of outputs and places of calls left open, event by event."""
    by_id, line, ms, stuck = {}, [], {}, []
    for i, call, s, kind in events:
        if s is None or kind not in ("start", "end"):
            continue
        call = call if call and call.strip() else None
        if kind == "start":
            if call:
                by_id[call] = (i, s)
            else:
                line.append((i, s))
        else:
            found = by_id.pop(call, None) if call else line.pop(0) if line else None
            if found:
                ms[i] = max(s - found[1], 0) * 1000
    return ms, sorted([i for i, _ in [*by_id.values(), *line]])


@pytest.mark.parametrize("seed", range(3))
def test_calls_in_any_order(spark, seed):
    rng, rows = random.Random(seed), []
    for k in "xyz":
        rows += [(k, i, rng.choice([None, None, "a", "b", " "]), rng.choice([None, *range(100)]), rng.choice(["start", "end", "end", "other"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, call string, s long, e string").withColumn("ts", F.timestamp_seconds("s"))
    got = outcomes.call_times(df, "k", "call", ["i"], "ts", F.col("e") == "start", F.col("e") == "end").collect()
    for k in "xyz":
        ms, stuck = queue([r[1:] for r in rows if r[0] == k])
        assert {r.i: r.ms for r in got if r.k == k and r.ms is not None} == ms
        assert sorted(r.i for r in got if r.k == k and r.left_open) == stuck


def test_who_answers(spark):
    rows = [("s", 1, "user", 0), ("s", 2, "tool", 50), ("s", 3, "assistant", 60), ("s", 4, "tool", 61), ("s", 5, "system", None), ("s", 6, "user", 70), ("s", 7, "assistant", None), ("s", 8, "assistant", 80), ("s", 9, "user", 80 + 1801), ("t", 1, "user", 5), ("u", 1, "assistant", 9), ("u", 2, "user", 3)]
    df = spark.createDataFrame(rows, "session_id string, position int, role string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert {r.session_id: (r.agent_response_ms, r.user_response_ms) for r in outcomes.response_times(df).collect()} == {"s": (35_000, 10_000), "t": (0, 0), "u": (0, 0)}
