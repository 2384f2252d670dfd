from collections import Counter

import corpus_pipeline
from vocalith.llm import jaccard, toxicity


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    groups = {r["component_id"] for r in jaccard.jaccard_components(kept).collect()}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir).cache()
    assert single.columns == docs.columns and Counter(r["doc_id"] for r in single.collect()) == Counter(groups)
    clean = corpus_pipeline.hide_personal_data(spark, single, sf_dir)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not clean.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+'").count()
    assert clean.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == groups
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == groups


def test_near_duplicate_stage_edges(spark, edge_docs, no_docs):
    out = corpus_pipeline.drop_near_duplicates(spark, edge_docs, "")
    assert out.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 3, 4, 5, None, 6, 7, 8])
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").count() == 0
