"""Distributed boosting against a plain numpy replay of its splits, a forest, and its own constraints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import boosting as bo
from seamline.operators import models as mo

NAMES = ["a", "b", "c", "d"]


def made(n, classes, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(3), rng.normal(size=n).round(3), rng.integers(0, 2, n).astype(float)])
    margin = np.column_stack([(k + 1) * 0.4 * x[:, 1] * (-1) ** k + 0.2 * k * (x[:, 0] > 5) + 0.8 * (x[:, 2] * k > 1) for k in range(classes)])
    p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    y = (p.cumsum(axis=1) < rng.random((n, 1))).sum(axis=1)
    x[rng.random(n) < 0.05, 2] = np.nan
    return x, y.astype(int), rng.uniform(0.2, 1, n)


def table(spark, x, y, w, held=lambda i: i % 4 == 3):
    rows = [(*(None if v != v and i % 2 else float(v) for v in r), int(k), float(u), bool(held(i))) for i, (r, k, u) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label int, w double, held boolean")


def replay(x, y, w, fit, fitted, o):
    """Every split of every tree in plain floats: its gain, and that no other split gains more."""
    bins = np.column_stack([np.where(np.isnan(v), 0, np.searchsorted(e, v)) for v, e in zip(x.T, fitted.edges, strict=True)])
    margin = np.tile(fitted.prior, (len(y), 1))
    signs = [o.monotone.get(f, 0) for f in NAMES]
    n_bins, checked = max(map(len, fitted.edges)) + 1, 0
    for grown in fitted.trees:
        if o.outputs == 1:
            p = 1 / (1 + np.exp(-margin))
            true = y[:, None] == 1
        else:
            p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
            true = y[:, None] == np.arange(o.classes)
        g, h = w[:, None] * (p - true), w[:, None] * p * (1 - p)
        for k, t in enumerate(grown):
            at = {0: np.flatnonzero(fit)}
            for i, f in enumerate(t.feature):
                if f < 0:
                    continue
                own = at[i]
                lo, hi = t.bounds[i]
                val = lambda r: float(np.clip(-g[r, k].sum() / (h[r, k].sum() + o.l2), lo, hi))  # noqa: B023, E731
                worth = lambda r, v: -(g[r, k].sum() * v + 0.5 * (h[r, k].sum() + o.l2) * v * v)  # noqa: B023, E731
                gains = {}
                for j in range(len(NAMES)):
                    for b in range(n_bins):
                        left, right = own[bins[own, j] <= b], own[bins[own, j] > b]
                        if min(len(left), len(right)) < o.least or signs[j] * (val(right) - val(left)) < 0:
                            continue
                        gains[j, b] = worth(left, val(left)) + worth(right, val(right)) - worth(own, val(own))
                assert t.gain[i] == pytest.approx(gains[f, t.bin[i]], rel=1e-4, abs=1e-4)
                assert t.gain[i] >= max(gains.values()) - 1e-3
                at[t.left[i]], at[t.right[i]] = own[bins[own, f] <= t.bin[i]], own[bins[own, f] > t.bin[i]]
                checked += 1
            margin[:, k] += t.values(bins)
    return checked, margin


@pytest.mark.parametrize("classes", [2, 4])
def test_splits_replayed(spark, classes):
    x, y, w = made(900, classes, classes)
    o = bo.Options(classes=classes, rounds=4, depth=3, rate=0.3, bins=12, least=15, keep=2, monotone={"b": -1} if classes == 2 else {})
    df = table(spark, x, y, w).repartition(5)
    fitted = bo.train(df, NAMES, weight="w", held_out="held", options=o)
    fit = np.arange(900) % 4 != 3
    checked, margin = replay(x, y, w, fit, fitted, o)
    assert checked >= 4 * o.outputs and fitted.best == 4 and len(fitted.losses) == 5
    np.testing.assert_allclose(fitted.model.margins(x), margin, atol=1e-9)
    p = mo.softmax(margin) if classes > 2 else np.column_stack([1 - mo.sigmoid(margin), mo.sigmoid(margin)])
    want = -(w * np.log(p[np.arange(900), y]))[~fit].sum() / w[~fit].sum()
    assert fitted.losses[-1] == pytest.approx(want, abs=1e-5) and fitted.losses[-1] < fitted.losses[0]
    again = bo.train(df.repartition(1), NAMES, weight="w", held_out="held", options=o)
    assert [(t.feature, t.bin, t.value) for r in again.trees for t in r] == [(t.feature, t.bin, t.value) for r in fitted.trees for t in r]
    back = mo.parse_ensemble(mo.format_ensemble(fitted.model), NAMES)
    np.testing.assert_array_equal(back.margins(x), fitted.model.margins(x))


def test_monotone_features_whatever_the_data_say(spark):
    rng = np.random.default_rng(3)
    x, y, w = made(1500, 2, 9)
    y = (rng.random(1500) < 0.5 + 0.3 * np.sin(3 * x[:, 1]) + 0.1 * (x[:, 0] > 6) * x[:, 3]).astype(int)  # not monotone at all
    o = bo.Options(rounds=8, depth=4, rate=0.3, bins=32, least=5, patience=100, monotone={"b": 1, "a": -1})
    fitted = bo.train(table(spark, x, y, w, lambda i: False), NAMES, options=o)
    base = x[:60].copy()
    base[:, 2] = np.nan_to_num(base[:, 2])
    for j, sign in ((1, 1), (0, -1)):
        p = []
        for v in np.linspace(-3, 13, 200):
            base[:, j] = v
            p.append(fitted.model.margins(base)[:, 0])
        assert (np.diff(p, axis=0) * sign >= 0).all()
    free = bo.train(table(spark, x, y, w, lambda i: False), NAMES, options=bo.Options(rounds=8, depth=4, rate=0.3, bins=32, least=5, patience=100))
    base[:, 1] = 0
    p = [free.model.margins(np.column_stack([base[:, 0], np.full(60, v), base[:, 2:]]))[:, 0] for v in np.linspace(-3, 3, 200)]
    assert (np.diff(p, axis=0) < 0).any() and free.losses[-1] < fitted.losses[-1]


def test_stops_early_and_beats_a_forest(spark):
    x, y, w = made(4000, 4, 5)
    df = table(spark, x, y, w).fillna(0.0)
    o = bo.Options(classes=4, rounds=40, depth=3, rate=0.3, bins=32, least=20, patience=3)
    fitted = bo.train(df, NAMES, held_out="held", options=o)
    assert fitted.best < len(fitted.trees) and fitted.losses[fitted.best] == min(fitted.losses)
    assert len(fitted.model.trees) == 4 * fitted.best
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    forest = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="v"), RandomForestClassifier(numTrees=20, maxDepth=4, seed=1, labelCol="label", featuresCol="v")]).fit(df.where("NOT held"))
    p = forest.transform(df.where("held")).select(F.get(vector_to_array("probability"), F.col("label")).alias("p_true"))
    assert fitted.losses[fitted.best] < mo.log_loss(p).first().log_loss


def test_odd_tables(spark):
    x, y, w = made(60, 2, 1)
    df = table(spark, x, y, w)
    nothing = bo.train(df.limit(0), NAMES)
    assert nothing.best == 0 and nothing.model.margins(x).shape == (60, 1) and not nothing.model.margins(x).any()
    one = bo.train(df.withColumn("label", F.lit(1)), NAMES, options=bo.Options(rounds=3))
    assert (one.model.margins(x) > 5).all()
    nulls = df.withColumn("label", F.when(F.col("a") > 5, F.col("label"))).withColumn("c", F.lit(None).cast("double")).withColumn("w", F.when(F.col("d") > 0, F.col("w")))
    got = bo.train(nulls, NAMES, weight="w", options=bo.Options(rounds=2, least=1))
    assert len(got.trees) == 2 and all(f != 2 for r in got.trees for t in r for f in t.feature)
    with pytest.raises(ValueError, match="labels"):
        bo.train(df.withColumn("label", F.lit(7)), NAMES)


def test_walked_as_a_table(spark):
    x, y, w = made(300, 4, 7)
    df = table(spark, x, y, w).withColumn("i", F.monotonically_increasing_id())
    fitted = bo.train(df, NAMES, options=bo.Options(classes=4, rounds=3, depth=4, rate=0.5, bins=16, least=3))
    fitted.model.trees[5] = {"feature": np.array([], int), "threshold": np.array([]), "left": np.array([], int), "right": np.array([], int), "default_left": np.array([], bool), "leaf": np.array([0.25])}
    rows = df.orderBy("i").collect()
    want = fitted.model.margins(np.array([[np.nan if r[c] is None else r[c] for c in NAMES] for r in rows]))
    got = {(r.i, r.output): r.margin for r in mo.walked(df, "i", fitted.model).collect()}
    assert len(got) == 4 * len(rows)
    np.testing.assert_allclose([[got[r.i, k] for k in range(4)] for r in rows], want, atol=1e-9)
