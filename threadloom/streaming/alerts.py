"""Alerts of lags above their baseline, with what was told before held as state across micro-batches.

A family's severity comes from its lag as a multiple of its baseline's p95. An alert is told when the
severity changes (a return to ok as well), and again after ``repeat_ms`` of the same. Each family has a
budget of ``budget`` alerts for each window of ``window_ms``; a return to ok is always told. Rows of a
family count in the order of their times within a micro-batch; a row older than one that counted
before is 'late' and changes nothing. Every row comes out with its outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WARNING, ERROR, LEAST_LAG_S, LEAST_SAMPLES = 5.0, 20.0, 30, 50
REPEAT_MS, WINDOW_MS, BUDGET = 3_600_000, 86_400_000, 10
OUT = "family string, at_ms long, severity string, outcome string"


def severity(lag_s: Column, stuck: Column, p95: Column, samples: Column) -> Column:
    """Ok for an idle family, a small lag, and a baseline of few samples or of 0."""
    known = (stuck > 0) & (lag_s >= LEAST_LAG_S) & (samples >= LEAST_SAMPLES) & (p95 > 0)
    return F.when(known & (lag_s >= ERROR * p95), "error").when(known & (lag_s >= WARNING * p95), "warning").otherwise("ok")


class _Alerts(StatefulProcessor):
    def __init__(self, repeat_ms: int, window_ms: int, budget: int):
        self.repeat_ms, self.window_ms, self.budget = repeat_ms, window_ms, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "severity string, told_ms long, last_ms long, window long, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, told_ms, last, window, used = self.told.get() if self.told.exists() else ("", 0, -(1 << 62), 0, 0)
        for frame in rows:  # a micro-batch's frames are not in order of time among each other, so what is older than one before is late
            frame = frame.sort_values(["at_ms", "severity"])
            outcomes = []
            for at, level in zip(frame["at_ms"].tolist(), frame["severity"].tolist(), strict=True):
                if at < last:
                    outcomes.append("late")
                    continue
                last = at
                if at // self.window_ms != window:
                    window, used = at // self.window_ms, 0
                changed = level != now and not (now == "" and level == "ok")
                if not changed and (level == "ok" or at - told_ms < self.repeat_ms):
                    outcomes.append("quiet" if level == "ok" else "repeat")
                elif level != "ok" and used >= self.budget:
                    outcomes.append("budget")
                else:
                    used += level != "ok"
                    now, told_ms = level, at
                    outcomes.append("told")
            yield pd.DataFrame({"family": key[0], "at_ms": frame["at_ms"], "severity": frame["severity"], "outcome": outcomes})
        self.told.update((now, told_ms, last, window, used))

    def close(self) -> None:
        pass


def alerts(samples: DataFrame, repeat_ms: int = REPEAT_MS, window_ms: int = WINDOW_MS, budget: int = BUDGET) -> DataFrame:
    """Samples (family, at_ms, lag_s, stuck, p95, samples) of a stream with their severity and outcome. The session's state store must be RocksDB's."""
    rows = samples.select("family", "at_ms", severity(F.col("lag_s"), F.col("stuck"), F.col("p95"), F.col("samples")).alias("severity"))
    return rows.groupBy("family").transformWithStateInPandas(_Alerts(repeat_ms, window_ms, budget), outputStructType=OUT, outputMode="Append", timeMode="None")
