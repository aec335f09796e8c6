"""Percentiles from counts against plain ones."""

import numpy as np

from threadloom.operators import aggregates


def test_linear_ranks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 101), (None, 7)) for v in rng.integers(0, 30, n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.x, r.y, r.z) for r in aggregates.linear_ranks(df, "k", "v", {"x": 0.0, "y": 0.37, "z": 0.95}).collect()}
    for k in ("a", "b", "c", None):
        assert np.allclose(got[k], np.percentile([v for q, v in rows if q == k], [0, 37, 95]))
    assert "d" not in got
    r = {x.k: x for x in aggregates.metrics(df.withColumn("v", df.v.cast("long")), "k", "v", [50]).collect()}
    assert (r["d"].n, r["d"].sum_v, r["d"].p50_v) == (1, None, None) and r["c"].n == 101 and r[None].n == 7
    values = sorted(int(v) for q, v in rows if q == "c")
    assert (r["c"].sum_v, r["c"].min_v, r["c"].p50_v) == (sum(values), values[0], values[50])
