"""Operator 10: trees below trees, equal vectors, and the share of vectors that is compared."""

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import ann


def brute(rows, asked, k):
    ids, x = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    out = {}
    for q in ids[asked]:
        s = (x * x[ids == q][0]).sum(axis=1)
        out[int(q)] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def recall(got, want):
    return sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def clustered(rng, groups, each, d=16):
    centres = rng.normal(size=(groups, d))
    return np.repeat(centres, each, axis=0) + 0.15 * rng.normal(size=(groups * each, d))


def test_leaves_are_split_level_by_level(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(clustered(rng, 40, 100))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = lists(ann.search(df, F.col("vec_id") % 20 == 0, 10, sample=200, leaf_rows=16, split_rows=80, bin_rows=128))
    want = brute(rows, np.arange(len(rows)) % 20 == 0, 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert recall(got, want) >= 0.9


def test_levels_were_needed(spark):
    """With these settings the first tree's leaves are too large, and those of the second hold few rows."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(clustered(rng, 40, 100))], "vec_id long, embedding array<double>")
    s = ann.Search(df, F.col("vec_id") % 20 == 0, 10, 0.94, 200, 16, 80, 128)
    tree = ann.fit(ann.matrix(s.rows.limit(200).select("v").toArrow().column(0).combine_chunks()), 8)
    rows = s.rows.toPandas()
    at = ann.leaves(tree, np.array(rows.v.tolist())) + 1
    placed = s.work.save(spark.createDataFrame([(0, int(a), int(i), [float(y) for y in v]) for a, i, v in zip(at, rows.vec_id, rows.v, strict=True)], f"parent long, leaf long, vec_id long, v {s.type}"), "p")
    counts = placed.groupBy("parent", "leaf").agg(F.count("*").alias("n"))
    splits = s.fitted(placed, counts, 0)
    assert splits.count() == counts.where("n > 80").count() > 0
    below = s.placed_below(placed, splits)
    assert below.count() == counts.where("n > 80").agg(F.sum("n")).first()[0]
    assert below.groupBy("leaf").count().agg(F.max("count")).first()[0] < counts.agg(F.max("n")).first()[0]


def test_a_vector_that_many_rows_hold(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 20, 50, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(v) for v in (x[k] if k % 3 else x[1])]) for k in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(k, np.array(v, np.float32).astype(float)) for k, v in rows]
    found = ann.search(df, F.col("vec_id") % 20 == 0, 5)
    got, want = lists(found), brute(rows, np.arange(len(rows)) % 20 == 0, 5)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert got[60] == want[60] == [0, 1, 3, 6, 9]  # equal vectors, least ids first
    work = ann.Search(df, F.col("vec_id") % 20 == 0, 5, 0.94, 100, 16, 80, 128)
    assert work.rows.groupBy("v").count().agg(F.max("count")).first()[0] == 6


def test_compared_share_falls():
    """The visited leaves hold a smaller share of the vectors when there are more of them."""
    share = []
    for n in (1000, 8000):
        rng = np.random.default_rng(7)
        x = clustered(rng, n // 100, 100)
        tree = ann.fit(x, 32)
        at, near = ann.leaves(tree, x), ann.priorities(tree, x[:100])
        size = np.bincount(at, minlength=len(tree.parent))
        true = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
        order = [ann.visits(tree.children, p.tolist(), len(p)) for p in near]
        ranks = np.array([[o.index(leaf) for leaf in at[t]] for o, t in zip(order, true, strict=True)])
        most = int(np.quantile(ranks, 0.94)) + 1
        share.append(np.mean([size[o[:most]].sum() for o in order]) / n)
    assert share[1] < 0.5 * share[0], share


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(5)], "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("score", F.lit(0)).withColumn("n", F.lit(2))
    assert lists(ann.search(df, F.col("vec_id") % 20 == 0, 3)) == {0: [4, 3, 2]}
