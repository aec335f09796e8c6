"""Streams: windowed counts with watermarks, sessions by gap, and refresh of touched groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Counts by window and kind; the same expression serves a table and a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def gap_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """I4 for streams in time order: a user's events with no gap over ``gap``."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def refresh_touched(touched: DataFrame, key: str, facts: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> None:
    """T5/T6, for foreachBatch: derives anew the groups that a batch touched, from all their facts."""
    keys = touched.select(key).distinct()
    write(derive(facts().join(keys, key, "left_semi")))


def first_in(events: DataFrame, keys: list[str], every: str = "60 seconds") -> DataFrame:
    """T4: of a key's events that come within ``every`` of each other, the first only; state is bounded by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", every).dropDuplicatesWithinWatermark(keys)


def lag_baseline(samples: DataFrame, key: str, value: str, over: str = "7 days", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and deviation of each key's samples in sliding windows."""
    samples = samples.withColumn("ts", F.col("ts").cast("timestamp"))
    if samples.isStreaming:
        samples = samples.withWatermark("ts", late)
    v = F.col(value)
    return samples.groupBy(F.window("ts", over, every).alias("w"), key).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "mean", "deviation")


def anomalies(samples: DataFrame, baseline: DataFrame, key: str, value: str, deviations: float = 3.0, least: int = 10) -> DataFrame:
    """Samples above the mean of the window that ended last before them by so many deviations."""
    ends = baseline.where(F.col("n") >= least).select(key, "ended", "mean", "deviation")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))  # windows end at midnight
    return samples.join(ends, (samples[key] == ends[key]) & (day == ends["ended"])).where(F.col(value) > F.col("mean") + deviations * F.col("deviation")).select(samples["*"], "mean", "deviation")
