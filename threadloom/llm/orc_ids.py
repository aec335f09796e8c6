"""Operator 9: token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded, and written by Spark's ORC writer:
integer run-length encoding for the ids, row indexes at a fixed stride, and Bloom filters on
doc_id. Stripes are the unit of parallel reads; filters on doc_id skip files, stripes and row
groups from metadata alone. Texts are what is shuffled: encoding first and sorting ids moves about as
many bytes, as ids compress less, and must write them once more.

Cases: null or empty text is the end id alone; a null doc_id sorts first; equal ids are ordered by
text hash and place in the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import tokens
from threadloom.llm.packing import END, spark_schema
from threadloom.llm.work import TASK_ROWS, Scratch, column, offsets, slices, small, table, texts

FILE = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.create.index": "true"}


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Writes the files: one for each range of doc_id, rows ascending."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids = [x + END.to_bytes(2, "little") for x in enc.encode(texts(batch))]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), lists], schema=FILE)
            at += int(ends[-1])

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_in"))
    ranged = keyed.repartitionByRange("doc_id", "_hash", "_in").sortWithinPartitions("doc_id", "_hash", "_in").select("doc_id", "text")
    ranged.mapInArrow(encode, spark_schema(FILE)).write.options(**ORC).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark_schema(FILE)).orc(path)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents with first <= doc_id <= last; stripes outside are skipped by their metadata."""
    return read_ids(spark, path).where(F.col("doc_id").between(first, last))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: ids before it, its count and their checksum."""
    files = read_ids(spark, path)
    begin = small(Scratch(spark).save(offsets(files, "part", F.col("n_tokens"), "part_offset"), "offsets"), TASK_ROWS)
    placed = files.join(begin, "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "ids")
            ends, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], schema=schema)

    return placed.mapInArrow(check, spark_schema(schema))


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("ids.orc")
    write_ids(table(spark, sf_dir, "documents"), path)
    return summary(spark, path)
