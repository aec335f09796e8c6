"""Counts with denominators, metrics, rollups, facets, ratios and paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import group_key


def multi_count(df: DataFrame, fields: list[str]) -> DataFrame:
    """A2/A3: counts by fields, with proportion of the exact total and missing and unknown keys counted."""
    keyed = df.select(*[group_key(F.col(f)).alias(f) for f in fields])
    counts = keyed.groupBy(*fields).agg(F.count("*").alias("n"))
    odd = lambda word: sum((F.col(f) == word).cast("int") for f in fields)
    total = counts.agg(F.sum("n").alias("denominator"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(*fields, "n", "denominator", F.round(F.col("n") / F.col("denominator"), 6).alias("proportion"), odd("[missing]").alias("missing_fields"), odd("unknown").alias("unknown_fields"))


def nearest_ranks(df: DataFrame, key: str, field: str, percentiles: list[float], prefix: str = "p") -> DataFrame:
    """A5: nearest-rank percentiles of each key, the least value at or below which that share of the values lies.

    Values are counted first and their counts summed in order, so no task holds a key's values at once.
    """
    w = Window.partitionBy(key)
    counts = df.where(F.col(field).isNotNull()).groupBy(key, field).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_to", F.sum("_n").over(w.orderBy(field).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * F.lit(p) / 100), F.col(field))).alias(f"{prefix}{p:g}") for p in percentiles])


def linear_ranks(df: DataFrame, key: str, field: str, shares: dict[str, float]) -> DataFrame:
    """(key, names) percentiles by linear interpolation between the two values around each share's place, from counts of values as in ``nearest_ranks``."""
    w = Window.partitionBy(key)
    counts = df.where(F.col(field).isNotNull()).groupBy(key, field).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_to", F.sum("_n").over(w.orderBy(field).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    place = {name: (F.col("_all") - 1) * F.lit(float(share)) for name, share in shares.items()}
    least = lambda at: F.min(F.when(F.col("_to") >= at + 1, F.col(field)))
    ends = [x for name, at in place.items() for x in (least(F.floor(at)).alias(f"_{name}_lo"), least(F.ceil(at)).alias(f"_{name}_hi"), F.max(at - F.floor(at)).alias(f"_{name}_part"))]
    return ranked.groupBy(key).agg(*ends).select(key, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in shares])


def with_ranks(plain: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """Aggregates of each key (null is one) with its percentiles, null where it has no values."""
    other = ranks.withColumnRenamed(key, "_key")
    return plain.join(other, plain[key].eqNullSafe(other["_key"]), "left").drop("_key")


def metrics(df: DataFrame, key: str, field: str, percentiles: list[int]) -> DataFrame:
    """A4/A5: count, sum, mean, bounds and nearest-rank percentiles; nulls are skipped. Values are counted once, and all comes from the counts."""
    v, n, w = F.col(field), F.col("_n"), Window.partitionBy(key)
    counts = df.groupBy(key, field).agg(F.count("*").alias("_n"))
    known = F.when(v.isNotNull(), n).otherwise(0)
    ranked = counts.withColumn("_to", F.sum(known).over(w.orderBy(v.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(known).over(w))
    rank = lambda p: F.min(F.when(v.isNotNull() & (F.col("_to") >= F.ceil(F.col("_all") * F.lit(p) / 100)), v)).cast("double")
    return ranked.groupBy(key).agg(
        F.sum("_n").alias("n"), F.sum(v * n).cast("double").alias(f"sum_{field}"), F.round(F.sum(v * n) / F.nullif(F.sum(known), F.lit(0)), 6).alias(f"avg_{field}"),
        F.min(field).alias(f"min_{field}"), F.max(field).alias(f"max_{field}"), *[rank(p).alias(f"p{p}_{field}") for p in percentiles],
    )


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """Values of each field with document counts and ln(N / df), in one pass over the table."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("facet", "value").agg(F.count("*").alias("df"))
    whole = counts.groupBy("facet").agg(F.sum("df").alias("_n"))  # a row for each field
    return counts.join(F.broadcast(whole), "facet").select("facet", "value", "df", F.round(F.log(F.col("_n") / F.col("df")), 6).alias("idf"))


def membership_stats(facts: DataFrame, key: str, member: str) -> DataFrame:
    """Per group facts and distinct members, and a total row."""
    return facts.rollup(key).agg(F.count("*").alias("facts"), F.count_distinct(member).alias("members"), F.grouping(key).alias("_g")).select(F.when(F.col("_g") == 1, "MATCHED").otherwise(F.col(key)).alias(key), "facts", "members")


def ratio(df: DataFrame, key: str, numerator: Column, known: Column) -> DataFrame:
    """Ratio over known rows, with the unknown counted; null where nothing is known."""
    hit, base = F.count_if(numerator & known), F.count_if(known)
    return df.groupBy(key).agg(hit.alias("numerator"), base.alias("denominator"), F.count_if(~known).alias("unknown_n"), F.round(F.try_divide(hit, base), 6).alias("ratio"))


def paired_difference(df: DataFrame, subject: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """Mean of per-subject differences between two arms, over subjects seen in both."""
    per = df.groupBy(subject).agg(F.avg(F.when(F.col(arm) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == b, F.col(value))).alias("b")).where("a is not null and b is not null")
    return per.agg(F.count("*").alias("subjects"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_difference"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Null below three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    r = F.when((F.count_if(both) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(x, y))), 4))
    return df.agg(F.count_if(both).alias("n"), r.alias("r"))


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, total, bounds, mean and linear percentiles, to six places."""
    v = F.col(value)
    plain = df.groupBy(key).agg(F.count(v).alias("n"), F.round(F.sum(v), 6).alias("total"), F.min(v).alias("least"), F.max(v).alias("largest"), F.round(F.avg(v), 6).alias("mean"))
    both = with_ranks(plain, linear_ranks(df, key, value, {"p50": 0.5, "p90": 0.9}), key)
    return both.select(key, "n", "total", "least", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "largest", "mean")


def median_floor(df: DataFrame, key: str, value: str) -> DataFrame:
    """The median of whole numbers, the mean of two middles rounded down."""
    low = F.expr(f"percentile_disc(0.5) within group (order by {value})")
    high = F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")
    return df.groupBy(key).agg(low.alias("_low"), high.alias("_high")).select(key, F.floor((F.col("_low") + F.col("_high")) / 2).cast("long").alias("median"))


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def multiset_digest(df: DataFrame, key: str, *members: Column) -> DataFrame:
    """Of each key's members, their count and two order-free sums of 48-bit hash parts; nulls are skipped.

    Sums combine before the shuffle, so no group's members are gathered in one place.
    """
    m = F.concat_ws("|", *members)
    part = lambda at: F.sum(F.conv(F.substr(F.sha2(m, 256), F.lit(at), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.where(F.concat(*members).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), part(1).alias("sum_a"), part(13).alias("sum_b"))


def rollup_sets(df: DataFrame, keys: list[str], sets: list[list[str]], **measures: Column) -> DataFrame:
    """I16: the measures by each set of keys, in one pass; ``grouping`` names the set."""
    at = {k: n for n, k in enumerate(keys)}
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *[m.alias(n) for n, m in measures.items()])
    name = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(keys) - 1 - at[k]) for k in keys if k not in s)
        name = F.when(F.col("_g") == bits, "-".join(s)).otherwise(name)
    return grouped.select(name.alias("grouping"), *keys, *measures)


def differing(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key and field, how many values it takes, nulls being one."""
    counts = df.groupBy(key).agg(*[(F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields])
    return counts.unpivot([key], fields, "field", "distinct_values")


def calibration(judged: DataFrame, keys: list[str], verdict: str, gold: str, item: str) -> DataFrame:
    """Agreement with gold over items that have it (null where none), and rates of non-answers."""
    share = lambda word: F.round(F.avg((F.col(verdict) == word).cast("double")), 6)
    both = F.col(gold).isNotNull() & F.col(verdict).isNotNull()
    return judged.groupBy(*keys).agg(F.count(item).alias("n"), F.count_if(both).alias("overlap"), F.round(F.try_divide(F.count_if(both & (F.col(verdict) == F.col(gold))), F.count_if(both)), 6).alias("agreement"), share("tie").alias("tie_rate"), share("abstain").alias("abstain_rate"))


def miss_diagnosis(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Matches with all predicates, and with each one dropped, in one pass over the table."""
    def all_but(left_out: str | None) -> Column:
        kept = F.lit(True)
        for name, p in predicates.items():
            if name != left_out:
                kept = kept & F.coalesce(p, F.lit(False))
        return kept

    counts = df.agg(F.count_if(all_but(None)).alias("none"), *[F.count_if(all_but(n)).alias(n) for n in predicates])
    return counts.unpivot([], ["none", *predicates], "dropped", "matches")
