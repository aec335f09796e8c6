"""Groups that a stream touches are derived anew, and only those."""

from pyspark.sql import functions as F

from threadloom.streaming import incremental


def test_touched_groups_are_refreshed(spark, tmp_path):
    source, facts, out = (str(tmp_path / x) for x in ("in", "facts", "out"))
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    first.write.parquet(facts)
    touched = []

    def write(derived):
        touched.append(sorted(r.k for r in derived.collect()))
        derived.write.mode("append").parquet(out)

    def batch(rows, _):
        rows.write.mode("append").parquet(facts)
        incremental.refresh_touched(rows, "k", lambda: spark.read.parquet(facts), lambda f: f.groupBy("k").agg(F.sum("v").alias("s")), write)

    for n, rows in enumerate(([("a", 10)], [("c", 7), ("c", 1), ("b", 1)])):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v long").parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None
    assert touched == [["a"], ["b", "c"]]
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 13), ("b", 6), ("c", 8)]
