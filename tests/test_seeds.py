"""Neighbours of a group of more vectors than go in one block."""

import numpy as np

from threadloom.operators import search


def test_a_large_seed_group(spark):
    x = np.random.default_rng(4).normal(size=(900, 4)).round(3)
    rows = [(k, [float(v) for v in x[k]], "hot" if k < 600 else "other") for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, session string")
    far = np.sqrt(((x[600:, None] - x[None, :600]) ** 2).sum(axis=2)).min(axis=1)
    want = sorted((round(float(d), 6), 600 + k) for k, d in enumerate(far))[:20]
    got = [(r.distance, r.vec_id) for r in search.nearest_to_seeds(df, "session", "hot", 20).collect()]
    assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want], atol=2e-6)
    assert search.nearest_to_seeds(df, "session", "none", 20).count() == 0


def test_missing_and_odd_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0], "hot"), (2, [3.0, None], "hot"), (3, [0.0, nan], "hot"), (4, [0.0, 0.0], "hot")]
    rows += [(10, [1.0, 1.0], "x"), (11, [3.5, 9.0], "x"), (12, None, "x"), (13, [None, 2.0], "x"), (14, [nan, 0.0], "x"), (15, [inf, 0.0], "x"), (16, [5.0], "x"), (17, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, session string")
    for seeds in (256, 1):
        got = [(r.vec_id, r.distance) for r in search.nearest_to_seeds(df, "session", "hot", 20, seeds).collect()]
        assert [i for i, _ in got] == [11, 10, 13, 16, 15, 14, 12]
        assert [d for _, d in got[:5]] == [0.5, 1.414214, 2.0, 2.0, inf] and np.isnan(got[5][1]) and got[6][1] is None


def test_a_group_of_copies(spark):
    df = spark.range(40_000).selectExpr("id AS vec_id", "array(0.1f, IF(id % 2 = 0, 0.2f, cast(id AS float)), 0.3f) AS embedding", "IF(id % 2 = 0, 'hot', 'x') AS session")
    got = search.nearest_to_seeds(df, "session", "hot", 2).collect()
    assert [(r.vec_id, r.distance) for r in got] == [(1, 0.8), (3, 2.8)]
