"""Ordered operators: pairing by rank, phases, gaps, streaks, sequences, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_by_rank(uses: DataFrame, results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The n-th use of a key pairs with its n-th result; uses without one are kept, as are uses without a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keyed = F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != "")
    u = uses.where(keyed).withColumn("rank", rank)
    r = results.where(keyed).select(*keys, rank.alias("rank"), F.lit(True).alias("found"), *[F.col(c).alias(f"result_{c}") for c in results.columns if c not in keys])
    paired = u.join(r, [*keys, "rank"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return paired.unionByName(uses.where(~F.coalesce(keyed, F.lit(False))).withColumn("found", F.lit(False)), allowMissingColumns=True)


def phases(df: DataFrame, key: str, ts: str, order: list[str], gap_seconds: int) -> DataFrame:
    """A gap over the threshold, either way in time, opens a phase; bounds are the least and largest times."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w))
    opened = df.withColumn("_new", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0))
    numbered = opened.withColumn("phase", F.sum("_new").over(w))
    return numbered.groupBy(key, "phase").agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def gaps(df: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Seconds since the row before, where positive."""
    w = Window.partitionBy(key).orderBy(*order)
    g = (F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)) / 1_000_000
    return df.withColumn("gap_s", g).where("gap_s > 0")


def longest_streak(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """The longest run of flagged rows in a key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = df.withColumn("_f", flag.cast("int")).withColumn("_run", F.sum(F.lit(1) - F.col("_f")).over(w)).where("_f = 1")
    return runs.groupBy(key, "_run").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def in_sequence(df: DataFrame, key: str, order: Column, steps: list[Column], edge: str = "ordered", within_ms: int = 0) -> DataFrame:
    """Q2: keys whose rows meet the steps in order; all candidates are followed, not the first only.

    edge: 'ordered' (later), 'next' (the row right after), 'within' (later, at most so many ms).
    All steps look at one ordering of a key's rows, so these are shuffled and sorted once: a row
    reaches a step if it meets it and some row before it reaches the step before.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("_0", steps[0])
    for k, step in enumerate(steps[1:]):
        had = F.col(f"_{k}")
        if edge == "next":
            reached = F.lag(had).over(w)
        elif edge == "within":
            reached = (F.col("_ms") - F.max(F.when(had, F.col("_ms"))).over(before)).between(0, within_ms)
        else:
            reached = F.max(had).over(before)
        rows = rows.withColumn(f"_{k + 1}", step & F.coalesce(reached, F.lit(False)))
    return rows.where(f"_{len(steps) - 1}").select(key).distinct()


def first_last(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first and last n rows of each key, once each."""
    up, down = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).where((F.col("_a") <= n) | (F.col("_b") <= n)).drop("_a", "_b")


def best_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """W2–W6."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def breach_day(daily: DataFrame, key: str, day: str, value: str, quota: float) -> DataFrame:
    """The first day on which a key's running total reaches the quota."""
    running = F.sum(value).over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("_t", running).where(F.col("_t") >= quota).groupBy(key).agg(F.min(day).alias("breach_day"))


def trailing_mean(daily: DataFrame, key: str, day: str, value: str, days: int) -> DataFrame:
    """W15."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(1 - days, 0)
    return daily.withColumn("trailing_mean", F.round(F.avg(value).over(w), 4))


def islands(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Adjacent rows of one label as one row, numbered from 0 in a key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = df.withColumn("_new", (~F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int"))
    runs = changed.withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(key, "run", label).agg(F.count("*").alias("n"), F.min(order[0]).alias("started"), F.max(order[0]).alias("ended"))


def signature_streaks(df: DataFrame, key: str, order: list[str], failed: Column, succeeded: Column, signature: str) -> DataFrame:
    """Longest run of failures of one signature; a success or another signature ends it, other rows don't count."""
    w = Window.partitionBy(key).orderBy(*order)
    told = df.where(failed | succeeded).withColumn("_s", F.when(failed, F.col(signature)))
    runs = told.withColumn("_new", (~F.lag("_s").over(w).eqNullSafe(F.col("_s"))).cast("int")).withColumn("_run", F.sum("_new").over(w)).where("_s is not null")
    return runs.groupBy(key, "_run").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def transitions(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """How often one label follows another within a key."""
    after = F.lead(label).over(Window.partitionBy(key).orderBy(*order))
    return df.select(F.col(label).alias("source"), after.alias("target")).where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def next_where(df: DataFrame, key: str, order: list[str], wanted: Column, value: str, out: str) -> DataFrame:
    """For each row, the value of the next row of its key that meets a condition; a running value over the order turned round."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(wanted, F.struct(value)), ignorenulls=True).over(w)[value])


def within_budget(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of a key in order while their sizes' sum stays in the budget; others carry a reason."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", total).withColumn("decision", F.when(F.col("used") <= budget, "included").otherwise("over_budget"))


def fire_within_budget(alerts: DataFrame, window: str, magnitude: str, item: str, floor: float, budget: int) -> DataFrame:
    """The largest deviations of each window fire while the budget lasts; those under the floor never do."""
    rank = F.row_number().over(Window.partitionBy(window, F.col(magnitude) >= floor).orderBy(F.desc(magnitude), item))
    return alerts.withColumn("decision", F.when(F.col(magnitude) < floor, "below_floor").when(rank <= budget, "fired").otherwise("over_budget"))


def outlook(daily: DataFrame, key: str, day: str, value: str, cycle_days: int) -> DataFrame:
    """Spent so far, projected to a cycle's end linearly and at the mean of the last seven days."""
    recent = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))
    per = daily.withColumn("_r", recent).groupBy(key).agg(F.count("*").alias("days"), F.sum(value).alias("spent"), F.avg(F.when(F.col("_r") <= 7, F.col(value))).alias("_recent"))
    left = F.greatest(F.lit(cycle_days) - F.col("days"), F.lit(0))
    return per.select(key, "days", F.round("spent", 3).alias("spent"), F.round(F.col("spent") / F.col("days") * cycle_days, 3).alias("linear"), F.round(F.col("spent") + F.col("_recent") * left, 3).alias("trailing"))


def quota_outlook(daily: DataFrame, key: str, day: str, value: str, cycle_days: int, quota: float) -> DataFrame:
    """The linear projection against a quota: share used, what would go over it, and the day it was or would be reached (from 1)."""
    to = F.sum(value).over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(day))
    per = daily.withColumn("_to", to).withColumn("_nth", nth).groupBy(key).agg(F.count("*").alias("days"), F.sum(value).alias("spent"), F.min(F.when(F.col("_to") >= quota, F.col("_nth"))).alias("_reached"))
    rate = F.col("spent") / F.col("days")
    ahead = F.when((rate > 0) & (rate * cycle_days >= quota), F.ceil(F.lit(float(quota)) / rate))
    return per.select(key, "days", F.round(F.col("spent") / quota, 4).alias("pressure"), F.round(F.greatest(rate * cycle_days - quota, F.lit(0.0)), 3).alias("overage"), F.coalesce(F.col("_reached").cast("long"), ahead).alias("breach_day"))


def split_phases(df: DataFrame, keys: list[str], order: list[str], kind: Column, longest: int = 15, least: int = 3) -> DataFrame:
    """(keys, start, stop) ranges of places in each phase; a phase of more than ``longest`` messages is split where the kind changes.

    kind: that of a message's first action, null where it has none. A range begins where a message and the one before it
    both have a kind, and another, if the range before has ``least`` messages then. Only places of changes are gathered.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.select(*keys, *order, kind.alias("_kind")).select(*keys, (F.row_number().over(w) - 1).alias("_i"), (F.lag("_kind").over(w) != F.col("_kind")).alias("_other"))
    phases_ = placed.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_other"), F.col("_i")))).alias("_at"))
    fold = "aggregate(_at, array(0), (s, i) -> IF(i - element_at(s, -1) >= {}, array_append(s, i), s))".format(least)
    starts = F.when(F.col("_n") > longest, F.expr(fold)).otherwise(F.array(F.lit(0)))
    each = phases_.select(*keys, "_n", starts.alias("_s")).select(*keys, "_n", "_s", F.posexplode("_s").alias("_k", "start"))
    return each.select(*keys, "start", F.coalesce(F.try_element_at("_s", F.col("_k") + 2), F.col("_n")).alias("stop"))
