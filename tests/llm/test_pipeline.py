import corpus_pipeline
from tests.llm.test_operators import SF, brute_components
from threadloom.llm import mixing, packing
from threadloom.llm.work import table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.good_documents(spark, docs, SF)
    assert kept.columns == docs.columns and 0.8 * docs.count() <= kept.count() <= docs.count()
    one = corpus_pipeline.one_of_each_group(spark, kept, SF)
    label, _ = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert sorted(r.doc_id for r in one.collect()) == sorted({v for v in label.values()})
    mix = corpus_pipeline.mixed(spark, one, SF)
    assert mix.columns == docs.columns and mix.count() == mixing.rated(one).toPandas().copies.sum()
    pieces = corpus_pipeline.packed(spark, mix, SF)
    assert pieces.where("start = 0").count() == mix.count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()
    assert pieces.count() == packing.pack(mix).count()
