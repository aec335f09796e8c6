"""Operator 9: what is in the files' metadata, and what a read by doc_id skips."""

import glob

import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from threadloom.llm import orc_ids
from threadloom.llm.work import Scratch

ROWS = 6000


@pytest.fixture(scope="module")
def path(spark):
    path = Scratch(spark).path("ids")
    docs = spark.range(0, ROWS).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit(9).alias("ids"), F.lit("x").alias("part"), F.lit("x").alias("_hash"))
    orc_ids.write_ids(docs.repartition(3), path)
    return path


def scanned(df):
    """Rows that the scan gave out, before Spark's own filter."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "Scan" in plan.nodeName():
            return plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(k) for k in range(plan.children().size())]


def test_files_hold_indexes(path):
    found = [orc.ORCFile(x.removeprefix("file://")) for x in glob.glob(f"{path.removeprefix('file://')}/*.orc")]
    assert found and all(f.row_index_stride == 1000 and f.compression == "ZSTD" and f.nstripes >= 1 for f in found)
    assert sum(f.nrows for f in found) == ROWS


def test_row_groups_outside_a_range_are_skipped(spark, path):
    got = orc_ids.read_range(spark, path, 2000, 2010)
    assert sorted(r.doc_id for r in got.collect()) == list(range(2000, 2011, 2))
    assert 6 <= scanned(got.select("doc_id")) <= 2000
    assert scanned(orc_ids.read_range(spark, path, 10**9, 10**9 + 5).select("doc_id")) == 0
    assert scanned(orc_ids.read_ids(spark, path).select("doc_id")) == ROWS


def test_bloom_filters_skip_ids_within_the_bounds(spark, path):
    """Odd ids lie between the least and largest of a row group: only the Bloom filter can tell them."""
    met = [scanned(orc_ids.read_ids(spark, path).where(F.col("doc_id") == k).select("doc_id")) for k in range(4001, 4041, 2)]
    assert sum(n == 0 for n in met) >= 17, met
    assert scanned(orc_ids.read_ids(spark, path).where(F.col("doc_id") == 4000).select("doc_id")) >= 1
