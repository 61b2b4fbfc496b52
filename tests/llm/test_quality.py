"""Statistics, kernel ridge and calibration against plain Python; held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import quality as ql
from tests.llm.test_textkit import plain_words

GOOD = "the river ran past quiet stones and the old mill while children gathered copper leaves under a bright winter sky".split()


def prose(rng, n):
    return " ".join(rng.choice(GOOD) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def junk(rng, n):
    kind = rng.randrange(3)
    w = [rng.choice(GOOD) for _ in range(n)]
    return " ".join(x.upper() + "!!" for x in w) if kind == 0 else " ".join(x + rng.choice(["***", "$$$"]) for x in w) if kind == 1 else " ".join([w[0]] * n)


def plain(text):
    """The statistics of one text, one by one."""
    b = (text or "").encode()
    t = text or ""
    byte = lambda ok: sum(map(ok, b)) / len(b) if b else 0
    among = lambda s: lambda c: chr(c) in s and c < 128
    letter = lambda c: c >= 128 or chr(c).isalpha()
    ends, marks, space = ".!?", ",;:'\"()-", "\t\n\x0b\x0c\r "
    symbol = lambda c: not (letter(c) or among("0123456789" + ends + marks + space)(c))
    words = plain_words(t)
    shown = re.findall("[^\x20\x09-\x0d]+", t)
    n = len(words)
    of = lambda ok: sum(map(ok, shown)) / n if n else 0
    size = [len(w.encode()) for w in words]
    mean = sum(size) / n if n else 0
    c = Counter(words)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in t.split("\n") if x]
    up = lambda w: sum("A" <= x <= "Z" for x in w)
    low = lambda w: sum("a" <= x <= "z" for x in w)
    n_ends = sum(map(among(ends), b))
    return [
        math.log1p(len(b)), math.log1p(n), math.log1p(len(lines)),
        byte(among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), byte(lambda x: x >= 128), byte(among("0123456789")), byte(among(space)), byte(among(ends)), byte(among(marks)), byte(symbol),
        mean, math.sqrt(max(0, sum(s * s for s in size) / n - mean**2)) if n else 0, sum(s > 20 for s in size) / n if n else 0,
        len(c) / n if n else 0, max(c.values()) / n if n else 0, sum(a == b for a, b in pairs) / len(pairs) if pairs else 0, len(set(pairs)) / len(pairs) if pairs else 0,
        (math.log(n) - sum(x * math.log(x) for x in c.values()) / n) / math.log(n) if n > 1 else 0,
        of(lambda w: not any(map(letter, w.encode()))), of(lambda w: up(w) >= 2 and not low(w)), of(lambda w: any(map(symbol, w.encode())) and any(map(letter, w.encode()))),
        math.log1p(sum(len(x.encode()) for x in lines) / len(lines)) if lines else 0, 1 - len(set(lines)) / len(lines) if lines else 0,
        sum(x[-1] in ends for x in lines) / len(lines) if lines else 0, math.log1p(n / max(1, n_ends)),
    ]


ODD = [None, "", " ", "\n\n", "a", "A B", "...", "é É 日本", "same same same\nsame\nsame\n", "x" * 50 + " 12 @#$ (a-b).", "SHOUT LOUD!!\nSHOUT LOUD!!", "\x00 nul\x00", "word " * 30000]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(3, 200)) if i % 3 else junk(rng, rng.randint(3, 200)) for i in range(600)]
    good = [int(i % 3 > 0) for i in range(600)]
    texts += ODD
    rows = [(i if i != 604 else None, t, -1.0, 9, "x") for i, t in enumerate(texts)]
    rows += [(700 + i, texts[1], -1.0, 9, "x") for i in range(300)]  # a third are copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, fold string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(good) if i % 2] + [(700 + i, 1) for i in range(150)] + [(None, 1), (605, None), (1, 0), (1, 1)], "doc_id long, quality int")
    stats = ql.statistics(docs, ["doc_id", "score"]).cache()
    return texts, good, docs, labels, stats


def test_statistics_of_each_text(made):
    texts, _, docs, _, stats = made
    rows = stats.collect()
    assert len(rows) == docs.count() and stats.columns == ["doc_id", "score", "stats", "fold"]
    by_id = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        np.testing.assert_allclose(by_id[i if i != 604 else None].stats, plain(t), rtol=1e-5, atol=1e-6, err_msg=repr((t or "")[:40]))
    assert len({by_id[i].fold for i in (1, *range(700, 1000))}) == 1


def test_scores_replayed_and_held_out(made):
    texts, good, docs, labels, stats = made
    model = ql.fit(stats, labels, features=96)
    truth = {r.doc_id: r.y for r in labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y")).collect()}
    rows = stats.collect()
    x = np.array([r.stats for r in rows])
    np.testing.assert_allclose(model.mean, x.mean(axis=0), rtol=1e-6, atol=1e-9)
    taught = [r for r in rows if r.doc_id in truth]
    f, y, fold = model.features(np.array([r.stats for r in taught])), np.array([truth[r.doc_id] for r in taught]), np.array([r.fold for r in taught])
    for k, (a, b, yy) in enumerate(ql.normal_equations(stats.join(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y")), "doc_id").where("y IS NOT NULL"), model)):
        np.testing.assert_allclose(a, f[fold == k].T @ f[fold == k], rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(b, f[fold == k].T @ y[fold == k], rtol=1e-8, atol=1e-8)
        assert yy == pytest.approx((y[fold == k] ** 2).sum())
    errors = {}
    for s in ql.RIDGES:
        w = [np.linalg.solve(f[fold != k].T @ f[fold != k] + np.diag([s * (fold != k).sum()] * 96 + [1e-9]), f[fold != k].T @ y[fold != k]) for k in range(ql.FOLDS)]
        errors[s] = (sum(((f[fold == k] @ w[k] - y[fold == k]) ** 2).sum() for k in range(ql.FOLDS)), w)
    best = min(errors, key=lambda s: errors[s][0])
    np.testing.assert_allclose(model.weights[:-1], errors[best][1], rtol=1e-3, atol=1e-4)
    whole = np.linalg.solve(f.T @ f + np.diag([best * len(y)] * 96 + [1e-9]), f.T @ y)
    raw = np.clip(model.features(x) @ whole, ql.LOW, ql.HIGH)
    want = (1 - ql.BLEND) * np.interp(raw, model.knots, model.shares) + ql.BLEND * (raw - ql.LOW) / 2
    got = ql.score(stats, model, ["doc_id", "score"]).toPandas()
    assert len(got) == docs.count() and list(got.columns) == ["doc_id", "score", "score", "predicted"]
    np.testing.assert_allclose(sorted(got.iloc[:, 2]), sorted(want), rtol=1e-3, atol=1e-4)
    held = {int(r.iloc[0]): r for _, r in got.iterrows() if r.iloc[0] == r.iloc[0] and r.iloc[0] < 600 and r.iloc[0] % 2 == 0}
    assert sum(r.iloc[3] == good[i] for i, r in held.items()) > 0.97 * len(held)
    assert got.iloc[:, 2].between(0, 1).all() and (got["predicted"] == (got.iloc[:, 2] >= 0.3)).all()


def test_the_features_are_a_gaussian_kernel():
    d, width = len(ql.NAMES), 3.0
    rng = np.random.default_rng(1)
    model = ql.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / width, (d, 20000)), rng.uniform(0, 2 * np.pi, 20000), np.zeros((5, 20001)), np.array([0.0]), np.array([0.0]))
    x = rng.normal(0, 0.6, (6, d))
    f = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2))
    np.testing.assert_allclose(f @ f.T, want, atol=0.04)


def test_pools_are_the_isotonic_fit():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 40).astype(float)
    good = np.array([rng.integers(0, k + 1) for k in n], float)
    at, share = ql.pooled(np.arange(40.0), n, good)
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
    best = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]  # the min-max formula
    assert sorted(set(np.round(best, 12))) == sorted(np.round(share, 12))


def test_without_labels_of_one_class_and_empty(spark, made):
    _, _, docs, labels, stats = made
    none = ql.fit(stats, labels.limit(0))
    assert {r.score for r in ql.score(stats, none, ["doc_id"]).collect()} == {0.5}
    ones = ql.fit(stats, labels.where("quality = 1"), features=32)
    assert all(r.predicted == 1 for r in ql.score(stats, ones, ["doc_id"]).collect())
    empty = ql.statistics(docs.limit(0), ["doc_id"])
    assert ql.score(empty, ql.fit(empty, labels), ["doc_id"]).count() == 0
    tables = spark.createDataFrame([(1, None)] * 20, "doc_id long, text string")
    alike = ql.statistics(tables, ["doc_id"])
    assert len({r.score for r in ql.score(alike, ql.fit(alike, labels), ["doc_id"]).collect()}) == 1
