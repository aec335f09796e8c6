"""Operator 7: mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source; targets are shares by weight, none above ``most`` times its source's
size (the excess goes to the others by weight); a source's rate is target / size. Each document
is taken floor(rate) times, and once more if its seeded hash falls below the fraction. Each source
uses the seed, of ``SEEDS`` tried in the same pass, whose total comes nearest its target: one
document's hash is uniform, but a few long documents would else move the total far.

Cases: null text and text without words have size 0 and, being no part of any total, follow the
rate like all others (taken is 0); a null source is a source, the last; an empty table gives no
rows; equal rows are treated alike; columns of the input are kept by
``mix``; those of ``rated`` (size, source_size, target, rate, copies) replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, fresh, small, table

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEEDS = 1.5, 2.0, 32
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 52


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _chance(seed: Column | int, key: str) -> Column:
    """A number in [0, 1) from the document's identity and the seed: 52 bits of a hash that SQL has too."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digits = F.substring(F.md5(F.concat_ws("-", seed.cast("string"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(UNIT))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with target and rate: one row for each source.

    With sources ordered by bound per weight, r, the water level is (share's total - bounds of the
    first j) / (weights of the others) for the least j whose level is at most the next r.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / rest
    levelled = listed.withColumn("_level", level).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    water = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(water, F.lit(float("inf"))) * F.col("_w"))
    return levelled.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def planned(docs: DataFrame, **how) -> tuple[DataFrame, str]:
    """All documents with a struct of size, source_size, target, rate and copies, and that column's name."""
    work = Scratch(docs.sparkSession)
    key, own, seed, size, plan_of = (fresh(x, docs) for x in ("_key", "_source", "_seed", "_size", "_plan"))
    sized = docs.withColumn(size, words(F.col("text"))).withColumn(key, F.concat_ws("-", F.col("doc_id").cast("string"), F.md5("text")))
    narrow = work.save(sized.select("source", F.col(size).alias("size"), F.col(key).alias("key")), "sizes")
    per = small(work.save(targets(narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), **how), "targets"))
    draws = narrow.join(per, narrow["source"].eqNullSafe(per["source"])).select(per["source"], "size", "rate", "target", "key")
    fraction = F.col("rate") - F.floor("rate")
    totals = draws.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * (F.floor("rate") + F.when(_chance(k, "key") < fraction, 1).otherwise(0))).alias(f"_{k}") for k in range(SEEDS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("far"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    seeds = small(work.save(totals.select(F.col("source").alias(own), nearest.alias(seed)), "seeds"))
    plan = per.join(seeds, per["source"].eqNullSafe(seeds[own])).select(F.col("source").alias(own), seed, F.struct("source_size", "target", "rate").alias(plan_of))
    plan = small(work.save(plan, "plan"))
    out = sized.join(plan, sized["source"].eqNullSafe(plan[own]))
    rate = F.col(plan_of)["rate"]
    copies = (F.floor(rate) + F.when(_chance(F.col(seed), key) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    fields = F.struct(F.col(size).alias("size"), *[F.col(plan_of)[x].alias(x) for x in ("source_size", "target", "rate")], copies.alias("copies"))
    return out.select(*docs.columns, fields.alias(plan_of)), plan_of


def rated(docs: DataFrame, **how) -> DataFrame:
    """All documents with size, source_size, target, rate and copies."""
    out, plan = planned(docs, **how)
    return out.drop(*(x for x in ("size", "source_size", "target", "rate", "copies"))).select("*", f"{plan}.*").drop(plan)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the input's columns as they are."""
    out, plan = planned(docs, **how)
    times = F.sequence(F.lit(1), F.col(plan)["copies"].cast("int"))
    return out.where(F.col(plan)["copies"] > 0).withColumn(plan, F.explode(times)).select(*docs.columns)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rated(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
