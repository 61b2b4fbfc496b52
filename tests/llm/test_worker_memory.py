"""What a task's Python workers hold: one worker a task, and batches of bounded bytes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import decontaminate, near_dup, shared
from seamline.llm import textkit as tk
from tests.llm.test_operators import prose


def test_batches_are_bounded_while_a_table_is_written(spark):
    before = spark.conf.get(shared.BATCH_BYTES)
    rows = spark.range(0, 500, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    got = shared.written(rows.mapInArrow(sizes, "n long"), "sizes", batch_bytes=1 << 16)
    assert max(r.n for r in got.collect()) < (1 << 16) + 2000
    assert spark.conf.get(shared.BATCH_BYTES) == before


def test_near_dup_bounds_every_batch(spark, monkeypatch):
    seen = []

    def keep(df, name, batch_bytes=None):
        seen.append((name, batch_bytes))
        return shared.written(df, name, batch_bytes)

    monkeypatch.setattr(near_dup, "_written", keep)
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate([*base, *(t + " end" for t in base)])), "doc_id long, text string")
    assert near_dup.near_duplicates(docs).where("kept").count() == len(base)
    assert {n for n, _ in seen} >= {"signatures", "sets", "near", "links", "met"} and all(b == shared.SMALL_BATCH for _, b in seen)


def test_decontamination_joins_without_a_second_worker(spark):
    rng = random.Random(5)
    passage = prose(rng, 30)
    docs = spark.createDataFrame([(1, prose(rng, 20) + " " + passage), (2, prose(rng, 50))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, passage)], "item_id long, text string")
    df = decontaminate.find_overlaps(docs, bench)
    assert [(r.doc_id, r.overlap_words) for r in df.collect()] == [(1, 30)]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_other_lengths_have_no_equal_word(spark):
    rows = [([1, 2, 3], [1, 9, 3]), ([1, 2], [1, 2, 3]), ([], [])]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>")
    assert [r[0] for r in df.select(decontaminate.equal_words(F.col("x"), F.col("y"))).collect()] == [2, 0, 0]


def test_stages_of_the_pipeline_send_small_batches(spark):
    before = spark.conf.get(shared.BATCH_BYTES)
    try:
        corpus_pipeline.prepare(spark)
        assert spark.conf.get(shared.BATCH_BYTES) == f"{shared.SMALL_BATCH}b"
    finally:
        spark.conf.set(shared.BATCH_BYTES, before)


def test_powers_of_the_word_hash_stay_as_small_as_the_chunk():
    tk._powers["p"] = tk._powers["p"][:1]
    for n in ((1 << 20) - 900, 1 << 20):
        assert len(tk._grown("p", tk._P, n)) == n
    assert len(tk._powers["p"]) == 1 << 20
