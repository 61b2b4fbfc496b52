"""What once was done for a part of the input only."""

import random

import numpy as np

from seamline.llm import recurrent_lm


def test_recurrent_lm_learns_from_every_training_row(spark):
    rng = random.Random(1)
    texts = ["copy " * 9] * 300 + [" ".join(["a b c d"] * 60 if rng.random() < 0.5 else ["x y z"] * 80) for _ in range(900)]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    counts = recurrent_lm.count_tokens(training).cache()
    model = recurrent_lm.fit(training, counts, vocabulary=9, per_class=4, hidden=16, sample_texts=1, updates=1)
    docs = spark.createDataFrame([(1, "a b c d " * 60), (2, "x y z " * 80)], "doc_id long, text string")
    got = recurrent_lm.score(docs, model, counts, ["doc_id"]).collect()
    assert all(r.score > 0.8 * r.base_score for r in got)  # one update alone leaves the base score
    assert model.learned == model.total
    assert all(np.isfinite(p).all() for p in model.net.params())
