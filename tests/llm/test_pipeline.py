import random

import corpus_pipeline
from seamline.llm import near_dup
from tests.llm.test_operators import docs_of, prose


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rng = random.Random(11)
    bench = [(0, prose(rng, 25)), (1, prose(rng, 30))]
    clean = [prose(rng, 90) for _ in range(20)]
    texts = [*clean, clean[0], clean[1] + " tail", prose(rng, 30) + " " + bench[0][1], "12 34", None, "", "write to someone.07@mail3.example.com " + prose(rng, 40)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = set(range(len(texts)))
    gone = [{23, 24, 25}, {20, 21}, {22}, set()]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        new = stage(spark, docs, str(tmp_path))
        assert new.columns == docs.columns, name
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept -= out
        assert {r.doc_id for r in docs.collect()} == kept, name
    text = {r.doc_id: r for r in docs.collect()}
    assert "someone.07" not in text[26].text and text[26].n_chars == len(text[26].text) and text[5].text == texts[5]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == kept and all(r.round_trip for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_pipeline_threshold():
    assert near_dup.SHINGLE == 5 and corpus_pipeline.NEAR_PERCENT == 80
