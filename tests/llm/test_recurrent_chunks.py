"""Scoring chunks of every kind: no text at all, no unknown word, no known word, some of each."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import recurrent_lm
from tests.llm.test_textkit import plain_words


def scored(spark, texts, training, **how):
    rows = [(i if i % 5 else None, t, -1.0, True, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _net boolean, at long")
    learned = spark.createDataFrame([(t,) for t in training], "text string")
    counts = recurrent_lm.count_tokens(learned).cache()
    model = recurrent_lm.fit(learned, counts, per_class=4, hidden=8, updates=5, rounds=1, **how)
    got = recurrent_lm.score(docs.repartition(1), model, counts, ["at", "doc_id", "_net"]).collect()
    c = Counter(w for t in training for w in [*plain_words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        words = [*plain_words(texts[r.at]), None]
        assert r.n_tokens == len(words) and r.n_known == sum(c[w] > 0 for w in words) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        assert math.isfinite(r.score) and r.score < 0 and r._net is True
    return got


@pytest.mark.parametrize(
    "texts",
    [[None] * 20, [""] * 20, ["a b", "b a b"] * 10, ["zz yy", "xx"] * 10, [None, "", "a zz", "c d " * 4000, "zz"]],
    ids=["nulls", "empty", "all known", "none known", "mixed"],
)
def test_every_chunk_is_scored(spark, texts):
    scored(spark, texts, ["a b c d", "a b", None] * 8, vocabulary=50)
    scored(spark, texts, ["a b c d", "a b", None] * 8, vocabulary=2, frequent=3)


def test_a_table_of_null_texts_learns_and_scores(spark):
    got = scored(spark, [None] * 20, [None] * 20)
    assert len({r.score for r in got}) == 1


def test_copies_score_alike_and_an_empty_table_gives_none(spark):
    got = scored(spark, ["a b zz", "c"] * 6, ["a b c d"] * 6, vocabulary=3)
    assert len({round(r.score, 9) for r in got}) == 2
    learned = spark.createDataFrame([("a b",)], "text string")
    counts = recurrent_lm.count_tokens(learned).cache()
    docs = learned.withColumn("doc_id", F.lit(1).cast("long")).limit(0)
    assert recurrent_lm.score(docs, recurrent_lm.fit(learned, counts), counts, ["doc_id"]).count() == 0


def test_scoring_and_look_up_take_the_short_way_to_the_same_result(monkeypatch):
    rng = np.random.default_rng(5)
    net = recurrent_lm.new_net(np.arange(90, 0, -1), per_class=8, hidden=16)
    size = np.r_[rng.integers(1, 40, 60), 700]  # one text goes on alone
    first = np.r_[0, np.cumsum(size)]
    ids = rng.integers(0, 90, first[-1]).astype(np.int32)
    want = []
    for lo, hi in zip(first, first[1:], strict=False):
        h, states = np.zeros((1, 16), np.float32), []
        for t in ids[lo:hi]:
            states.append(h)
            h = recurrent_lm.step(net, h, np.array([t]))[0]
        want.append(recurrent_lm.log_prob(net, np.concatenate(states), ids[lo:hi]).sum())
    monkeypatch.setattr(recurrent_lm, "step", None)  # keeps what only learning needs
    np.testing.assert_allclose(recurrent_lm.score_texts(net, ids, first), want, rtol=1e-5)

    near = np.uint64(7 << 60) + np.arange(0, 300, 3, dtype=np.uint64)  # many that begin alike
    known = np.unique(np.r_[near, rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)])
    model = recurrent_lm.Model(net, known, np.arange(len(known)) + 1, np.arange(len(known)) % 90, 0, 0, 0, 0)
    h = np.r_[known, near + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)]
    at = {int(k): i for i, k in enumerate(known)}
    c, tok = model.look_up(h)
    assert c.tolist() == [at.get(int(x), -2) + 1 for x in h]
    assert tok.tolist() == [at[int(x)] % 90 if int(x) in at else model.unknown for x in h]


def test_gradients_of_the_softmax_are_those_of_its_definition():
    rng = np.random.default_rng(8)
    for scale in (1.0, 300.0):  # logits as they are, and shifted by their greatest
        h, w, b = rng.normal(0, scale, (50, 6)), rng.normal(0, 1, (6, 9)), rng.normal(0, 1, 9)
        target, dh = rng.integers(0, 9, 50), np.ones((50, 6))
        a = h @ w + b
        p = np.exp(a - a.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        want = (p - np.eye(9)[target]) / 40
        _, g_w, g_b = recurrent_lm._loss(h, w, b, target, 40, dh)
        np.testing.assert_allclose(g_w, h.T @ want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(g_b, want.sum(axis=0), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(dh, 1 + want @ w.T, rtol=1e-9, atol=1e-9)
