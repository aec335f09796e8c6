"""Operator 10: leaves of a few outliers beside large groups of equal vectors."""

from pyspark.sql import functions as F

from threadloom.llm import ann


def test_every_query_gets_all_its_rows(spark):
    unit = lambda d, x: [float(x) if k == d else 0.0 for k in range(13)]
    vectors = [unit(d, 1) for d in range(12) for _ in range(400)] + [unit(12, 1000 * 2**k) for k in range(6)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    asked = (F.col("vec_id") % 100 == 0) & (F.col("vec_id") < 4800) | (F.col("vec_id") == 4805)
    got = {r.query_id: r["count"] for r in ann.search(df, asked).groupBy("query_id").count().collect()}
    assert got == dict.fromkeys([*range(0, 4800, 100), 4805], 20)
