"""Operator 2: what the exchange of pseudo-labels does, calibration, and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import quality
from threadloom.llm.work import Scratch, table


@pytest.fixture(scope="module")
def few(spark):
    """All documents with views, few labels to learn from, and the other labels."""
    work = Scratch(spark)
    seen = work.save(quality.with_views(table(spark, "/root/testdata/sf0.1", "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "_v.t", "_v.m", "_v.h"), "seen")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    return work, seen, labels.where("doc_id % 7 = 0"), seen.join(labels.where("doc_id % 7 <> 0").select("doc_id", "quality"), "doc_id").toPandas()


def accuracy(model, rest):
    scores = model.score(np.array(rest.t.tolist()), np.array(rest.m.tolist()))
    return [float(((s >= 0.5) == (rest.quality == 1)).mean()) for s in scores], scores


@pytest.fixture(scope="module")
def two_views(spark):
    """Two noisy views of one hidden class, of very many documents with few labels."""
    rng = np.random.default_rng(9)
    n = 8000
    y = rng.integers(0, 2, n)
    t = rng.normal(size=(n, 40)) + 0.8 * np.where(y, 1, -1)[:, None] * (np.arange(40) < 5)
    m = rng.normal(size=(n, 44)) + 0.8 * np.where(y, 1, -1)[:, None] * (np.arange(44) < 5)
    seen = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(t.tolist(), m.tolist(), strict=True))], "doc_id long, t array<float>, m array<float>").withColumn("h", F.xxhash64("t", "m"))
    labels = spark.createDataFrame([(k, int(y[k])) for k in range(400)], "doc_id long, quality int")
    return Scratch(spark).save(seen, "seen"), labels, t[400:], m[400:], y[400:]


def test_pseudo_labels_teach_both_views(two_views, spark):
    seen, labels, t, m, y = two_views
    alone, taught = (quality.train(seen, labels, Scratch(spark), rounds) for rounds in (0, quality.ROUNDS))
    assert alone.taught == (0, 0) and min(taught.taught) > 2 * quality.EACH, taught.taught
    for a, b in ((alone.text, taught.text), (alone.metadata, taught.metadata)):
        assert np.abs(a.weights - b.weights).max() > 0.05
    before, after = ([float(((s >= 0.5) == y).mean()) for s in x.score(t, m)] for x in (alone, taught))
    print("held-out accuracy of text, metadata and both: without exchange", before, "with", after)
    assert after[0] > before[0] and after[1] > before[1] and after[2] >= before[2]


def test_views_are_calibrated(few, spark):
    """Of documents scored about p, about a share p is good; here the metadata tell nothing, and teach nothing."""
    _, seen, labels, rest = few
    model = quality.train(seen, labels, Scratch(spark))
    assert model.taught[0] == 0 < model.taught[1]
    scores = model.score(np.array(rest.t.tolist()), np.array(rest.m.tolist()))
    for s in scores:
        for lo, hi in ((0.0, 0.2), (0.8, 1.01)):
            part = (s >= lo) & (s < hi)
            if part.sum() > 200:
                assert abs(s[part].mean() - (rest.quality[part] == 1).mean()) < 0.08
    right = ((scores[2] >= 0.5) == (rest.quality == 1)).mean()
    assert right > 0.93, right


def test_later_rounds_take_other_documents(few, spark, monkeypatch):
    work, seen, labels, _ = few
    got = []
    real = quality.sample_of_sure

    def watched(pool, models, bounds, taken, salt):
        before, out = set(taken), real(pool, models, bounds, taken, salt)
        got.append((before, [set(rows.h) for _, _, rows, _ in out]))
        return out

    monkeypatch.setattr(quality, "sample_of_sure", watched)
    quality.train(seen, labels, Scratch(spark))
    assert len(got) == quality.ROUNDS and all(not (s & before) for before, sets in got for s in sets)
    assert len(got[2][0]) > len(got[1][0]) > 0 == len(got[0][0])


def test_clashing_columns_and_few_labels(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("score", F.lit("mine")).withColumn("accepted", F.lit("x")).withColumn("t", F.lit(1)).withColumn("y", F.lit(2)).withColumn("h", F.lit(3)).withColumn("quality", F.lit(4))
    for labels in (table(spark, "/root/testdata/sf0.001", "labels"), table(spark, "/root/testdata/sf0.001", "labels").limit(3)):
        out = quality.scored(docs, labels)
        assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["accepted"] == "boolean" and {"t", "y", "h", "quality"} <= set(out.columns)
        assert out.count() == docs.count() and out.where("t <> 1 or y <> 2 or h <> 3 or quality <> 4").count() == 0
