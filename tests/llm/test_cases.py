"""Clashing columns, one id with several texts, and pipelines over odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, ODD
from threadloom.llm import html_blocks, mixing, near_dedup, packing, sharding
from threadloom.llm.work import Scratch

CLASHES = ["part", "ids", "at", "rows", "rep", "sig", "n", "label", "sketch", "kept", "component_id", "size", "rate", "copies", "_key", "_TEXT", "start", "y", "t", "h", "_v"]


def clashing(df):
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"own{k}"))
    return df


def test_packing_beside_clashing_columns(spark):
    df = spark.createDataFrame(ODD, DOCS)
    key = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    got, want = (sorted(map(str, packing.pack(x).select(key).collect())) for x in (clashing(df), df))
    assert len(got) >= len(ODD) and sum("start=0," in x for x in got) == len(ODD) == sum("start=0," in x for x in want)


def test_main_text_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>One.</article>")], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))
    assert [tuple(r) for r in html_blocks.extract(df).collect()] == [(1, "u", "One.", 4)]


def test_dedup_beside_clashing_columns(spark):
    df = clashing(spark.createDataFrame(ODD, DOCS))
    out = near_dedup.dedup(df)
    assert out.columns == df.columns and out.where("sig <> 'own5' or kept <> 'own9'").count() == 0
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "7", "8", "None"]


def test_mix_and_shards_beside_clashing_columns(spark):
    df = clashing(spark.createDataFrame(ODD, DOCS)).withColumn("_place", F.lit(0)).withColumn("_source", F.lit(0))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() > 0 and mixed.where("rate <> 'own12' or copies <> 'own13' or _key <> 'own14'").count() == 0
    out = sharding.shard_rows(df, [F.col("doc_id"), F.col("text")], 4)
    assert out.count() == len(ODD) and {"_place", "_source", "part"} <= set(out.columns)


def test_dedup_keeps_different_texts_of_one_id(spark):
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(1, words), (1, "quite another text of eight words in all"), (1, words), (2, words + " more"), (None, words), (None, words), (3, "third one")]
    got = sorted(map(str, near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(got) == 5 and sum("quite another" in x for x in got) == 1 and not any("more" in x for x in got) and sum("doc_id=None" in x for x in got) == 2


@pytest.mark.parametrize("rows", [[], ODD, [(k, None, None, None, None) for k in range(3)], [(5, "same text of five words", "en", "a", 23)] * 4], ids=["empty", "odd", "null", "repeated"])
def test_pipeline_over_odd_tables(spark, rows):
    root = Scratch(spark).path("in")
    spark.createDataFrame(rows, DOCS).withColumn("rate", F.lit("own")).withColumn("score", F.lit(1)).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    got = corpus_pipeline.run(spark, root).collect()
    assert all(r.length > 0 and r.offset + r.length <= 1024 for r in got)
    at = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and (not at or at[0][0] == 0)
    if rows and rows[0] == rows[-1]:
        assert {r.doc_id for r in got} == {5} and 1 <= sum(r.start == 0 for r in got) <= 2
    if not rows:
        assert got == []
