"""Operator 1: shards by a keyed permutation of global row numbers.

Rows are numbered in a stated order; a Feistel network permutes the numbers 0 to N-1 (cycle
walking keeps it inside N). Position p belongs to shard p mod S at slot p div S. So any row's
place, and any place's row, is computable from (row number, N, S, seed) with no table.

Cases: null keys sort first; null text has size 16 (no bytes) and crc 0; rows equal in all order
columns are interchangeable; an empty table gives no rows; input columns named like results are
replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, numbered, table

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with wrap-around arithmetic."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return left << shift | right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A bijection of 0..n-1 (``back``: its inverse); values that leave the range are mapped again until they return."""
    x = np.asarray(x).astype(np.uint64)
    if n < 2:
        return x.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = _mix(np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = _network(x, half, keys, back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, keys, back)
    return x.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(df: DataFrame, order: list[Column], shards: int = 40, seed: int = 20_240_601) -> DataFrame:
    """All rows with law ('rows': counts differ by one at most), row_number, shard and slot (gapless from 0 in each shard)."""
    work = Scratch(df.sparkSession)
    rows = numbered(df.drop("row_number", "law", "shard", "slot"), order, work, "rows", "row_number")
    n = df.sparkSession.read.parquet(work.path("rows")).count()

    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    out = rows.withColumn("_p", position("row_number"))
    return out.select("*", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot")).drop("_p")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    out = shard_rows(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("_hash")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
