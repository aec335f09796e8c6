"""Decisions on judgements and evidence: routing, bootstrap intervals, ancestry walks and alert budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import graph
from threadloom.scratch import folder, written

# States of a reference and the flag each raises; flags that do not block.
STATES = {"expired": "expired-ref", "stale": "stale-ref", "missing": "missing-ref", "ambiguous": "ambiguous-ref", "quarantined": "quarantined-ref", "private": "private-or-excised"}
NOT_BLOCKING = ["epoch-skew", "definition-incompatible", "frame-coverage-drift"]


def route(verdict: Column, stakes: Column, disagreed: Column, quota: Column, agreement: Column, overlap: Column, least_agreement: float = 0.8, least_overlap: int = 5) -> Column:
    """The reason for a person's review, the first that holds; null lets the verdict pass."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(verdict.isin("abstain", "insufficient_evidence", "incomparable"), "non-decisive")
        .when(yes(stakes), "high-stakes")
        .when(yes(disagreed), "disagreement")
        .when(yes(quota), "quota")
        .when(agreement.isNull(), "no-calibration")
        .when(overlap < least_overlap, "little-gold")
        .when(agreement < least_agreement, "low-agreement")
    )


#: P(at most k) of a Poisson distribution of mean 1, for k from 0 on.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]


def bootstrap(df: DataFrame, key: str, value: str, item: str, resamples: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """A group's mean with its percentile bootstrap interval; null bounds for fewer than two rows.

    A row's weight in a resample is drawn from a Poisson distribution of mean 1 by a hash of the seed, the
    resample and the row's item, so that resamples are sums which each task adds up for itself: only
    ``resamples`` rows a group leave it, and reruns agree. For enumerations that are whole there is
    no sampling error, and no interval should be asked for.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"), F.col(item).cast("string").alias("_i"))
    each = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_r").cast("string"), "_i")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    weight = sum((u >= F.lit(p)).cast("int") for p in POISSON)
    means = each.withColumn("_w", weight).groupBy(key, "_r").agg((F.sum(F.col("_w") * F.col("_v")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m")).where("_m is not null")
    w = Window.partitionBy(key)
    placed = means.withColumn("_k", F.row_number().over(w.orderBy("_m", "_r")) - 1).withColumn("_n", F.count("*").over(w))
    alpha = (1 - confidence) / 2
    at = lambda share: F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1)
    bounds = placed.groupBy(key).agg(F.max(F.when(F.col("_k") == at(alpha), F.col("_m"))).alias("lo"), F.max(F.when(F.col("_k") == at(1 - alpha), F.col("_m"))).alias("hi"))
    plain = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    enough = F.col("n") >= 2
    return plain.join(bounds, key, "left").select(key, "n", F.round("mean", 6).alias("mean"), F.when(enough, F.round("lo", 6)).alias("lo"), F.when(enough, F.round("hi", 6)).alias("hi"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of each node that is reachable from itself."""
    return graph.strong_components(edges).select("node")


def ancestry(roots: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags (root, node, kind, path) on all evidence that a root cites, and each root's status.

    roots: (node); nodes: (node, state, epoch, version, frame, complete); edges: (a, b), a citing b.
    A path is the least of the shortest from the root. Status: clean, flagged, or blocked where any
    flag but a skew or drift is raised.
    """
    work, k = folder(edges.sparkSession, "ancestry"), 0
    front = written(roots.select(F.col("node").alias("root"), "node", F.array("node").alias("path")).distinct(), f"{work}/0")
    reached = front
    links = edges.select("a", "b").distinct()
    while front.limit(1).count():
        k += 1
        onward = front.join(links, front["node"] == links["a"]).groupBy("root", F.col("b").alias("node")).agg(F.min(F.array_append("path", F.col("b"))).alias("path"))
        front = written(onward.join(reached.select("root", "node"), ["root", "node"], "left_anti"), f"{work}/{k}")
        reached = written(reached.unionByName(front), f"{work}/all-{k}")
    own = nodes.select(F.col("node").alias("root"), F.col("epoch").alias("_epoch"), F.col("version").alias("_version"), F.col("frame").alias("_frame"))
    cyclic = on_cycles(links).withColumn("_cyclic", F.lit(True))
    told = reached.join(nodes.withColumn("_known", F.lit(True)), "node", "left").join(own, "root", "left").join(cyclic, "node", "left")
    state = F.try_element_at(F.create_map(*[F.lit(x) for p in STATES.items() for x in p]), F.col("state"))
    skew = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNotNull() & (F.col(c) != F.col(f"_{c}"))
    known = F.col("_known").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(~known, "missing-ref"), F.when(F.col("_cyclic"), "circular-ancestry"), F.when(known, state), F.when(skew("epoch"), "epoch-skew"), F.when(skew("version"), "definition-incompatible"),
        F.when(skew("frame") | (known & ~F.coalesce("complete", F.lit(True))), "frame-coverage-drift"),
    ))
    flags = written(told.select("root", "node", F.explode(F.array_distinct(kinds)).alias("kind"), "path"), f"{work}/flags")
    worst = flags.groupBy("root").agg(F.bool_or(~F.col("kind").isin(NOT_BLOCKING)).alias("_block"))
    status = F.when(F.col("_block"), "blocked").when(F.col("_block").isNotNull(), "flagged").otherwise("clean")
    return flags, roots.select(F.col("node").alias("root")).distinct().join(worst, "root", "left").select("root", status.alias("status"))


def alert_decisions(candidates: DataFrame, window: str, floor: float, cooldown_ms: int, budget: int) -> DataFrame:
    """What becomes of each candidate (watch, deviation, at_ms, last_ms, degraded): floor, then cooldown, then degraded frames, then the window's budget.

    The largest deviations of those that are left have the budget; ties go to the smaller watch.
    """
    size = F.abs("deviation")
    reason = F.when(size < floor, "suppressed-magnitude-floor").when(F.col("at_ms") - F.col("last_ms") < cooldown_ms, "suppressed-cooldown").when(F.coalesce("degraded", F.lit(False)), "suppressed-frame-degraded")
    told = candidates.withColumn("_why", reason)
    place = F.row_number().over(Window.partitionBy(window, F.col("_why").isNull()).orderBy(F.desc(size), "watch"))
    return told.withColumn("outcome", F.coalesce("_why", F.when(place <= budget, "fired").otherwise("suppressed-budget"))).drop("_why")
