"""The logical tables (sessions, messages, actions, …) bound to the Parquet tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", "text", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("word_count"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, a session being a user's stream."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("kind"), "value", F.col("props").alias("tool_id"), (F.col("event_type") == "error").cast("int").alias("is_error"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: origin, state, time and cost."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("origin"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("sort_key"), F.col("o_custkey").alias("project"), F.col("o_totalprice").alias("cost"))
