"""Helpers that the operators share: scratch tables, prefix offsets, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of at most this many rows of a few short columns are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: Tables with one row of two numbers for each task are broadcast up to this size (64 MB).
TASK_ROWS = 4_000_000

#: Texts are worked on in slices of about this many bytes, to bound a Python worker's memory.
SLICE_BYTES = 2_000_000

#: Rows in an Arrow batch where the session does not say, as documents can be long.
BATCH_ROWS = 1000


class Scratch:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one, but only on a single machine."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.root = f"{base}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table and returns a reader of it, so that lost executors cost no earlier work."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(nullable(df.schema)).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, or with underscores added, that is no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (materialised) table marked for broadcast if its counted rows are few, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int = 0) -> DataFrame:
    """The ``rows`` rows of least hash of their key; all but few others are dropped before any are sent on."""
    total, space = df.count(), 1 << 30
    h = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(space))
    part = df.where(h < int(space * (1.2 * rows + 200) / total)) if total > 1.2 * rows + 200 else df
    return part.orderBy(h, key).limit(rows)


def where_row() -> tuple[Column, Column]:
    """Of a row: its task's partition and its place there, from monotonically_increasing_id's layout."""
    at = F.monotonically_increasing_id()
    return F.shiftright(at, 33).cast("int"), at.bitwiseAND(F.lit((1 << 33) - 1))


def offsets(table: DataFrame, part: str, size: Column, out: str) -> DataFrame:
    """Per partition number, the sum of ``size`` over all smaller ones: one row for each task, not for each record."""
    totals = table.groupBy(part).agg(F.sum(size).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias(out))


def numbered(df: DataFrame, order: list[Column], work: Scratch, name: str, out: str) -> DataFrame:
    """Adds gapless numbers from 0 in the given order.

    Range partitions are sorted and saved with each row's place; partition totals give the
    offsets. Rows that tie are told apart by their place in the input, so a frequent key spreads
    over many partitions.
    """
    came, part, place, start = (fresh(x, df) for x in ("_in", "_part", "_place", "_start"))
    in_part, at = where_row()
    keys = [*order, F.col(came)]
    ranged = df.withColumn(came, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(came)
    table = work.save(ranged.select("*", in_part.alias(part), at.alias(place)), name)
    starts = small(work.save(offsets(table, part, F.lit(1), start), f"{name}-starts"), TASK_ROWS)
    return table.join(starts, part).withColumn(out, F.col(start) + F.col(place)).drop(part, place, start)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of the column, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        first, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if held and held + n > limit:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's values; null is the empty text."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
