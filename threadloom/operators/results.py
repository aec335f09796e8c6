"""Result sets: snapshots, differences and standing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.scratch import folder, written


def snapshot(df: DataFrame, key: str, path: str) -> DataFrame:
    """V2: writes the members and returns the written table."""
    df.select(key).distinct().write.parquet(path)
    return df.sparkSession.read.parquet(path)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Members added and removed between two results."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    added = b.join(a, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def aligned(left: DataFrame, right: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Two sessions' rows side by side by position: equal, changed or only in one."""
    a = left.select(on, F.struct(*fields).alias("_a"))
    b = right.select(on, F.struct(*fields).alias("_b"))
    state = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("changed")
    return a.join(b, on, "full").select(on, state.alias("state"))


def corrected(rows: DataFrame, corrections: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """The latest correction of each key laid over the derived value."""
    newest = corrections.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), version).alias("_c"))
    return rows.join(newest, key, "left").withColumn(value, F.coalesce("_c.v", value)).drop("_c")


def merkle_roots(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members, root): the root of a tree of SHA-256 over each key's sorted member hashes.

    Two neighbours make one hash a level up; the last of an odd number is taken twice. Members are
    numbered within 4096 ranges of their hashes, so one large key is many tasks' work, and each level
    is a written table of half the rows.
    """
    root, k = folder(df.sparkSession, "merkle"), 0
    hashed = df.select(key, F.sha2(F.col(member).cast("string"), 256).alias("h")).withColumn("_range", F.substring("h", 1, 3))
    sizes = hashed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy("h")) - 1
    level = written(hashed.withColumn("_at", place).join(before, [key, "_range"]).select(key, "h", (F.col("_at") + F.col("_before")).alias("n")), f"{root}/0")
    count = level.groupBy(key).agg(F.count("*").alias("members"))
    while level.where("n > 0").limit(1).count():
        k += 1
        pair = level.groupBy(key, F.floor(F.col("n") / 2).alias("n")).agg(F.min_by("h", "n").alias("a"), F.max_by("h", "n").alias("b"), F.max("n").alias("_last"))
        single = F.col("n") == 0
        alone = level.groupBy(key).agg(F.max("n").alias("_top"))
        level = written(pair.join(alone, key).select(key, F.when(single & (F.col("_top") == 0), F.col("a")).otherwise(F.sha2(F.concat("a", "b"), 256)).alias("h"), "n"), f"{root}/{k}")
    return level.select(key, F.col("h").alias("root")).join(count, key)


def cohort(candidates: DataFrame, size: int, cap: int | None, seed: str = "", cursor: str = "") -> tuple[DataFrame, DataFrame]:
    """(ref, stratum, template, place) of a sample that takes strata by turns, and per stratum population, eligible, selected with the sample's shortfall.

    candidates: (ref, stratum, template, excluded). A stratum's candidates stand in the order of a seeded hash; at its turn the
    first one counts whose template (null: none) was taken fewer than ``cap`` times in the whole sample. No more than ``cap`` of
    a stratum and template, and of those 2 * ``size`` of a stratum, can come up (at most ``size`` rows are of templates that are
    full), so the pass by turns sees a bounded number of rows for each stratum.
    """
    rank = F.sha2(F.concat_ws("\0", F.lit(seed), F.lit(cursor), F.col("ref").cast("string")), 256)
    known = candidates.select(F.col("ref").cast("string").alias("ref"), F.coalesce(F.col("stratum").cast("string"), F.lit("unknown")).alias("stratum"), F.col("template").cast("string").alias("template"), "excluded", rank.alias("h"))
    fit = known.where(~F.coalesce(F.col("excluded"), F.lit(False)))
    alike = F.row_number().over(Window.partitionBy("stratum", F.coalesce("template", "ref"), F.col("template").isNull()).orderBy("h", "ref"))
    some = fit.withColumn("k", alike).where(F.col("template").isNull() | (F.col("k") <= (size if cap is None else cap)))
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "ref"))).where(F.col("k") <= 2 * size)

    def by_turns(rows):
        import pandas as pd

        rows = rows.sort_values(["stratum", "k"])
        lines = {s: [(r, t if isinstance(t, str) else None) for r, t in zip(g["ref"], g["template"], strict=True)] for s, g in rows.groupby("stratum", sort=True)}
        at, taken, out, active = dict.fromkeys(lines, 0), {}, [], list(lines)
        while active and len(out) < size:
            onward = []
            for s in active:
                while at[s] < len(lines[s]):
                    ref, t = lines[s][at[s]]
                    at[s] += 1
                    if t is None or cap is None or taken.get(t, 0) < cap:
                        taken[t] = taken.get(t, 0) + 1
                        out.append((ref, s, t, len(out)))
                        break
                if at[s] < len(lines[s]):
                    onward.append(s)
                if len(out) == size:
                    break
            active = onward
        return pd.DataFrame(out, columns=["ref", "stratum", "template", "place"])

    path = folder(candidates.sparkSession, "cohort")
    taken = written(first.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(by_turns, "ref string, stratum string, template string, place long"), f"{path}/taken")
    counts = known.groupBy("stratum").agg(F.count("*").alias("population"), F.count_if(~F.coalesce(F.col("excluded"), F.lit(False))).alias("eligible"))
    got = taken.groupBy("stratum").agg(F.count("*").alias("selected"))
    short = taken.agg(F.greatest(F.lit(size) - F.count("*"), F.lit(0)).alias("shortfall"))
    return taken, counts.join(got, "stratum", "left").crossJoin(F.broadcast(short)).select("stratum", "population", "eligible", F.coalesce("selected", F.lit(0)).alias("selected"), "shortfall")
