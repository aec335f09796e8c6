"""Statistics of JSON columns: paths, formats, shapes and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.scratch import folder, written


def flattened(df: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """(key, path, type, value) for each value of the JSON text, to any depth unless one is given; broken text gives no rows.

    Each round opens the objects and arrays of the one before, which is a written table, until none is left.
    """
    root, n = folder(df.sparkSession, "flattened"), 0
    level, found = df.select(key, F.lit("$").alias("path"), F.expr(f"try_parse_json({json})").alias("_v")).where("_v is not null"), []
    while not found or ((depth is None or n < depth) and found[-1].where("type rlike '^(OBJECT|ARRAY)'").limit(1).count()):
        inner = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()).toDF("pos", "key_", "value_"))
        level = inner.select(key, F.concat("path", F.coalesce(F.concat(F.lit("."), "key_"), F.lit("[]"))).alias("path"), F.col("value_").alias("_v"))
        n += 1
        found.append(written(level.select(key, "path", F.expr("schema_of_variant(_v)").alias("type"), F.expr("cast(_v as string)").alias("value")), f"{root}/{n}"))
        level = found[-1].where("type rlike '^(OBJECT|ARRAY)'").select(key, "path", F.expr("parse_json(value)").alias("_v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def path_stats(flat: DataFrame, key: str) -> DataFrame:
    """H1/H3: per path rows, records, nulls, distinct values and lengths."""
    return flat.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct(key).alias("records"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("value").alias("distinct_values"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"))


def shapes(flat: DataFrame, key: str) -> DataFrame:
    """H6: records by their set of (path, type), as a hash; a record has few paths."""
    per = flat.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "type"))), ","), 256).alias("shape"))
    return per.groupBy("shape").agg(F.count("*").alias("records"), F.min(key).alias("example"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """H7: paths and types that came, went or changed between two flattened tables."""
    types = lambda df, name: df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias(name))
    both = types(before, "type_before").join(types(after, "type_after"), "path", "full")
    change = F.when(F.col("type_before").isNull(), "added").when(F.col("type_after").isNull(), "removed").otherwise("retyped")
    return both.where(~F.col("type_before").eqNullSafe(F.col("type_after"))).withColumn("change", change)


def log_buckets(df: DataFrame, key: str, value: str, base: float = 1.1) -> DataFrame:
    """H2: counts of positive values by logarithmic bucket; zero and negative ones share bucket null."""
    bucket = F.when(F.col(value) > 0, F.floor(F.log(F.col(value)) / F.log(F.lit(base)) + 1e-9).cast("long"))
    return df.where(F.col(value).isNotNull()).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sketches(df: DataFrame, keys: list[str], value: str, base: float = 1.02) -> DataFrame:
    """H2/H3: per keys count, bounds, a sketch of distinct values and counts by logarithmic bucket: what merges without the rows.

    keys are those of a stored part, as a path and a day. Values of 0 or less share bucket null.
    """
    v = F.col(value)
    bucket = F.when(v > 0, F.floor(F.log(v) / F.log(F.lit(base)) + 1e-9).cast("long"))
    whole = df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.hll_sketch_agg(v.cast("string")).alias("distinct"))
    counts = df.where(v.isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    return whole.join(counts, keys)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """H2/H3: stored sketches as those of all their rows."""
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("distinct").alias("distinct"))
    long = parts.select(*keys, F.explode("buckets").alias("b")).groupBy(*keys, "b.bucket").agg(F.sum("b.n").alias("n"))
    return whole.join(long.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "n")).alias("buckets")), keys)


def told(sketch: DataFrame, keys: list[str], quantiles: list[float], base: float = 1.02) -> DataFrame:
    """What sketches tell: n, bounds, the estimate of distinct values, and each nearest-rank quantile within a factor of ``base`` (0 for values of 0 or less)."""
    def at(q: float) -> Column:
        fold = f"aggregate(array_sort(transform(buckets, b -> struct(coalesce(b.bucket, -9223372036854775807L) AS bucket, b.n AS n))), cast((0L, null) as struct<t:long,b:long>), (s, b) -> cast((s.t + b.n, IF(s.b is null and s.t + b.n >= ceil(n * {q}D), b.bucket, s.b)) as struct<t:long,b:long>), s -> s.b)"
        middle = F.pow(F.lit(base), F.expr(fold) + 0.5)
        return F.when(F.expr(fold) == -9223372036854775807, 0.0).otherwise(middle)

    return sketch.select(*keys, "n", "least", "most", F.hll_sketch_estimate("distinct").alias("distinct"), *[at(q).alias(f"p{q * 100:g}") for q in quantiles])


def members(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """H2: the different values of each stored part, where their number must be exact; ``counted`` merges parts without the rows."""
    return df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("member")).distinct()


def counted(parts: DataFrame, keys: list[str]) -> DataFrame:
    """H2: how many different values stored parts hold together."""
    return parts.select(*keys, "member").distinct().groupBy(*keys).agg(F.count("*").alias("distinct"))


def collapsed(flat: DataFrame, most: int = 50) -> DataFrame:
    """H5: paths whose keys are data and not names become one: a key that is a number, a hash or a UUID, or one of more than ``most`` beside each other, is ``*``."""
    parts = flat.withColumn("parent", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).withColumn("key", F.regexp_extract("path", r"([^.]*)$", 1))
    wide = parts.groupBy("parent").agg(F.count_distinct("key").alias("_keys"))
    is_id = F.rlike("key", F.lit(r"^([0-9]+|[0-9a-f]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"))
    named = parts.join(wide, "parent").withColumn("path", F.when(is_id | (F.col("_keys") > most), F.concat("parent", F.lit(".*"))).otherwise(F.col("path")))
    return named.select(*flat.columns)


def relations(flat: DataFrame, least: float = 0.95, values: int = 20) -> DataFrame:
    """H8: (child, parent, shared): paths whose values lie in another's, of at least so many different values and such a share of them.

    Different values meet once for each two paths that hold them, so the pairs grow with the paths, which
    are few, and not with the rows.
    """
    seen = flat.where(F.col("value").isNotNull()).select("path", "value").distinct()
    sizes = seen.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") >= values)
    kept = seen.join(sizes, "path")
    lists = kept.groupBy("value").agg(F.collect_list(F.struct("path", "_n")).alias("_p")).where(F.size("_p") > 1)
    pair = lists.select(F.explode("_p").alias("c"), "_p").select("c", F.explode("_p").alias("p")).where("c.path <> p.path")
    met = pair.groupBy(F.col("c.path").alias("child"), F.col("p.path").alias("parent"), F.col("c._n").alias("_c"), F.col("p._n").alias("_p")).agg(F.count("*").alias("shared"))
    return met.where((F.col("shared") >= F.col("_c") * least) & (F.col("_c") <= F.col("_p"))).select("child", "parent", "shared")


def synthetic(flat: DataFrame, rows: int, seed: int = 0, values: int = 50) -> DataFrame:
    """H9: (id, json): made-up records of the paths seen, each with a value that the path has had and as often there as in the records.

    A path's values are the ``values`` of least hash; paths without objects and lists below them are
    taken, so a record is flat. The same seed gives the same records.
    """
    leaf = flat.where("type not rlike '^(OBJECT|ARRAY)' and path not like '%[]%'")
    seen = leaf.groupBy("path").agg(F.count("*").alias("_n")).withColumn("_share", F.col("_n") / F.max("_n").over(Window.partitionBy()))  # one row for each path
    held = leaf.select("path", "value").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("value", F.lit(seed)), "value"))).where(F.col("_r") <= values)
    lists = held.groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("_values")).join(seen, "path")
    draw = lambda salt: F.pmod(F.xxhash64("id", "path", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    made = flat.sparkSession.range(rows).join(F.broadcast(lists))  # a bounded row for each path
    kept = made.where((draw(1) < F.col("_share") * (1 << 30)) & (F.size("_values") > 0))
    value = F.element_at("_values", (F.pmod(draw(2), F.size("_values")) + 1).cast("int"))
    return kept.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.regexp_replace("path", r"^\$\.", "").alias("k"), value.alias("v")))))).alias("json"))
