"""JSON records in and bundles out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str, longest: int = 16_000_000) -> DataFrame:
    """One row for each line, with a state: 'ok', 'invalid' or 'too_long'; bad lines are kept, not dropped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("record", F.from_json("value", T.StructType.fromDDL(schema).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}))
    state = F.when(F.length("value") > longest, "too_long").when(F.col("record").isNull() | F.col("record._bad").isNotNull(), "invalid").otherwise("ok")
    return parsed.withColumn("state", state).select("state", "record.*", "value").drop("_bad")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The latest revision of each key; a tie goes to the larger content hash."""
    newest = df.groupBy(key).agg(F.max(F.struct(F.col(version), F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("_h"), F.struct(*df.columns).alias("_row"))).alias("_m"))
    return newest.select("_m._row.*")


def write_bundle(df: DataFrame, path: str) -> None:
    """K1: the rows as JSON lines, and a one-row manifest of count and schema."""
    df.write.json(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).json(f"{path}/rows")
    written.agg(F.count("*").alias("rows")).withColumn("schema", F.lit(df.schema.json())).coalesce(1).write.json(f"{path}/manifest")
