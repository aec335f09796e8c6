"""The kept index against one built anew, folding of what users ask, and substrings by grams."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scalars import query_terms
from threadloom.operators import index as ix
from threadloom.operators import search
from threadloom.scratch import folder

ROWS = [(1, "Le café noir"), (2, "plain text License"), (3, "Łódź is a city, łódź"), (4, "café au lait"), (5, None), (6, "noir café"), (7, "")]


def scores(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_queries_are_folded(spark):
    docs = spark.createDataFrame(ROWS, "doc long, text string")
    index = search.write_index(docs, "doc", "text", f"{folder(spark, 'index')}/folded")
    for asked, want in (("café", [1, 4, 6]), ("CAFE", [1, 4, 6]), ("License", [2]), ("Łódź", [3]), ("lodz", [3])):
        assert sorted(r.doc for r in search.search_index(index, [asked]).collect()) == want
        assert scores(search.bm25(docs, "doc", "text", [asked])) == scores(search.search_index(index, [asked]))
        assert sorted(r.doc for r in search.boolean(index, [asked]).collect()) == want
    assert [r.doc for r in search.phrase_in_index(index, ["café noir"]).collect()] == [1]
    assert [r.doc for r in docs.where(search.phrase(F.col("text"), ["Café", "NOIR"])).collect()] == [1]
    assert sorted(r.doc for r in search.boolean(index, none=["café"]).collect()) == [2, 3, 5, 7]
    assert query_terms(["Café-noir", "noir", "_x"]) == ["cafe", "noir", "x"]
    assert search.bm25(docs, "doc", "text", ["--"]).count() == 0


@pytest.mark.parametrize("like", [2, 3])
def test_changes_equal_a_new_index(spark, like):
    rng, words = random.Random(like), ["red", "blue", "green", "license", "Łódź"]
    path = folder(spark, "index")
    index, now = ix.Index(spark, f"{path}/kept"), {}
    for batch in range(6):
        changes = [(d, " ".join(rng.choices(words, k=rng.randrange(6))), rng.random() < 0.3) for d in rng.sample(range(20), 8)]
        for d, text, gone in changes:
            now.pop(d, None)
            if not gone:
                now[d] = text
        df = spark.createDataFrame(changes, "doc long, text string, deleted boolean")
        index.apply(df, f"b{batch}")
        index.apply(df, f"b{batch}")  # once is enough
        if batch % 2:
            index.merge(like)
    source = spark.createDataFrame(list(now.items()), "doc long, text string")
    new = search.write_index(source, "doc", "text", f"{path}/new")
    assert index.counts() == new.counts() and len(index.state()) < 6
    for asked in (["red"], ["license", "lodz"]):
        assert scores(search.search_index(index, asked)) == scores(search.search_index(new, asked))
    index.clean()
    assert index.drift(source).count() == 0
    other = source.where("doc > 5").withColumn("text", F.when(F.col("doc") == 7, "x").otherwise(F.col("text"))).union(spark.createDataFrame([(99, "new")], "doc long, text string"))
    want = sorted([(d, "extra") for d in now if d <= 5] + [(99, "missing")] + [(7, "stale")] * (7 in now and now[7] != "x"))
    assert sorted(map(tuple, index.drift(other).collect())) == want


def test_stream_of_changes(spark, tmp_path):
    schema = "doc long, text string, deleted boolean, at long"
    index = ix.Index(spark, f"file://{tmp_path}/index")
    run = lambda: ix.follow(index, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([(1, "red", False, 1), (1, "blue", False, 2), (2, "red red", False, 1)], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    run()
    assert [r.doc for r in search.search_index(index, ["red"]).collect()] == [2]
    spark.createDataFrame([(2, None, True, 3), (3, "red", False, 3)], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    run()  # after a restart
    assert [r.doc for r in search.search_index(index, ["red"]).collect()] == [3] and index.counts() == (2, 2)


def test_substrings(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choices("abAB é", k=rng.randrange(30)))) for k in range(200)] + [(500, None), (501, ""), (502, "50% of_all")]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    path = f"{folder(spark, 'grams')}/t"
    ix.write_grams(docs, "doc", "text", path)
    for part in ("abA", "B é", "ab", "50% of_", "nowhere at all", "aba"):
        want = sorted(k for k, t in rows if t and part in t)
        for listed in (1000, 0):
            assert sorted(r.doc for r in ix.containing(spark, path, part, listed).collect()) == want


def test_grams_of_long_texts_and_of_any_case(spark):
    long = "abcdefghij" * 200_000  # a cost quadratic in its length would take hours
    rows = [(1, long + "needle"), (2, "ΑΒΣΑ"), (3, "x😀y😀"), (4, "nee"), (4, "dle needle"), (5, "ΑΒΣ")]
    path = f"{folder(spark, 'grams')}/long"
    ix.write_grams(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", path)
    for part, want in (("needle", [1, 4]), ("ΑΒΣ", [2, 5]), ("😀y😀", [3]), ("x😀y", [3]), ("jab", [1])):
        for listed in (1000, 0):
            assert sorted(r.doc for r in ix.containing(spark, path, part, listed).collect()) == want


def test_postings_are_gathered_by_documents(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc", "concat('red ', IF(id % 3 = 0, 'blue red', 'green'), ' w', id % 5) AS text").union(spark.createDataFrame([(7, "zzz red")], "doc long, text string")).repartition(2)
    path = f"{folder(spark, 'index')}/gathered"
    index = search.write_index(docs, "doc", "text", path)
    assert spark.read.parquet(f"{path}/postings").count() < 100  # instead of a row for each document and term
    got = index.postings(["red", "zzz"], places=True).where("doc in (3, 4, 7)").collect()
    assert sorted((r.doc, r.term, r.tf, r.dl, tuple(r.places)) for r in got) == [(3, "red", 2, 4, (0, 2)), (4, "red", 1, 3, (0,)), (7, "red", 1, 2, (1,)), (7, "zzz", 1, 2, (0,))]
    assert search.phrase_in_index(index, ["blue", "red"]).count() == 1000 and index.counts() == (3000, 3 * 2000 + 1000 * 4 - 1)


def test_gathering_in_slices(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3, 4], "dl": [2, 0, 3, 1], "terms": pa.array([["a", "b"], None, ["b", "a", "b"], ["b"]], pa.list_(pa.string()))})
    found = []
    for size in (1, 3, 100):
        monkeypatch.setattr(ix, "GATHERED", size)
        rows = [r for b in ix._gather_terms(iter([batch])) for r in b.to_pylist()]
        found.append(sorted((r["term"], d, s, tuple(r["places"][a:e])) for r in rows for d, s, a, e in zip(r["docs"], r["sizes"], [0, *r["ends"]], r["ends"])))
    assert found[0] == found[1] == found[2] == [("a", 1, 2, (0,)), ("a", 3, 3, (1,)), ("b", 1, 2, (1,)), ("b", 3, 3, (0, 2)), ("b", 4, 1, (0,))]


def test_nothing_to_index(spark):
    path, none = folder(spark, "empty"), spark.createDataFrame([], "doc long, text string")
    index = search.write_index(none, "doc", "text", f"{path}/index")
    assert search.search_index(index, ["red"]).count() == 0 and index.counts() == (0, 0) and index.drift(none).count() == 0
    index.apply(spark.createDataFrame([(1, "", False), (2, None, False)], "doc long, text string, deleted boolean"))
    assert search.search_index(index, ["red"]).count() == 0 and index.counts() == (2, 0)
    ix.write_grams(none, "doc", "text", f"{path}/grams")
    assert ix.containing(spark, f"{path}/grams", "abc").count() == 0


def test_kept_index_follows_its_table(spark, tmp_path):
    at = f"file://{tmp_path}/t.parquet"
    spark.createDataFrame([(1, "red"), (2, "blue")], "doc long, text string").write.parquet(at)
    asked = lambda: sorted(r.doc for r in search.search_index(search.kept_index(spark.read.parquet(at), "doc", "text"), ["red"]).collect())
    assert asked() == asked() == [1]
    spark.createDataFrame([(3, "red red")], "doc long, text string").write.mode("append").parquet(at)
    assert asked() == [1, 3]
    spark.createDataFrame([(2, "red"), (3, "blue")], "doc long, text string").write.mode("overwrite").parquet(at)
    assert asked() == [2]
    for path, _ in search._KEPT.values():
        shutil.rmtree(path.removeprefix("file://"))
    assert asked() == [2]
