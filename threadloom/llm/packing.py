"""Operator 3: packing by concatenate and cut.

Pass one encodes each document (its ids, then the end id 0) and saves it with its place in its
partition's token stream. Partition totals, summed over smaller partition numbers, turn that into
global offsets. Pass two cuts the one stream at multiples of the length: a document that spans a
boundary becomes several pieces. Only the last sequence needs padding.

Cases: null or empty text is the end id alone; equal rows are packed each; texts of any length are
cut freely; an empty table gives no pieces; other columns of the input are ignored.
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
from threadloom.llm.work import TASK_ROWS, Scratch, column, offsets, slices, small, table, texts

LENGTH = 1024
END = 0
STREAM = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids_crc32", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def stream(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document its ids (two bytes each) and where they begin among its partition's."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids = [x + END.to_bytes(2, "little") for x in enc.encode(texts(batch))]
            n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], schema=STREAM)
            at = int(ends[-1])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, spark_schema(STREAM))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """All pieces; ``with_ids`` adds each one's ids as little-endian unsigned 32-bit numbers."""
    work = Scratch(docs.sparkSession)
    saved = work.save(stream(docs, vocabulary or tokens.default_vocabulary()), "stream")
    begin = small(work.save(offsets(saved, "part", F.col("doc_tokens"), "part_offset"), "offsets"), TASK_ROWS)
    placed = saved.join(begin, "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("at"), "ids")
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            rows: list[tuple] = []
            for doc, at, raw in zip(*(column(batch, x).to_pylist() for x in ("doc_id", "at", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                cuts = [at, *range(at - at % length + length, at + len(ids), length), at + len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece = ids[a - at : b - at].tobytes()
                    rows.append((doc, a - at, zlib.crc32(piece), b - a, len(ids), a // length, a % length, *[piece] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.mapInArrow(cut, spark_schema(schema))


def op3_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
