"""Scoring of tree ensembles in the LightGBM text format, calibration and evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.scan import in_order


@dataclass
class Ensemble:
    """Numeric-split trees as flat arrays; tree i adds to class i mod ``classes``."""

    classes: int
    features: list[str]
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): rows walk a tree together, a level a step."""
        out = np.zeros((len(x), self.classes))
        for i, t in enumerate(self.trees):
            node = np.zeros(len(x), np.int64) if len(t["threshold"]) else np.full(len(x), -1)
            live = np.flatnonzero(node >= 0)
            while len(live):
                k = node[live]
                v = x[live, t["feature"][k]]
                left = np.where(np.isnan(v), t["default_left"][k], v <= t["threshold"][k])
                node[live] = np.where(left, t["left"][k], t["right"][k])
                live = live[node[live] >= 0]
            out[:, i % self.classes] += t["leaf"][-node - 1]
        return out


def parse_ensemble(text: str, expected: list[str] | None = None) -> Ensemble:
    """Reads a model; categorical splits, linear leaves, wrong array lengths or another feature order are errors."""
    head, *blocks = text.split("\nTree=")
    meta = dict(x.split("=", 1) for x in head.splitlines() if "=" in x)
    classes, names = int(meta.get("num_class", 1)), meta["feature_names"].split()
    if expected is not None and names != expected:
        raise ValueError("the model's features are not those expected")
    if not blocks or len(blocks) % classes:
        raise ValueError("trees are no multiple of classes")
    model = Ensemble(classes, names)
    for block in blocks:
        kv = dict(x.split("=", 1) for x in block.split("\n\n")[0].splitlines()[1:] if "=" in x)
        if int(kv.get("num_cat", 0)) or int(kv.get("is_linear", 0)):
            raise ValueError("categorical splits and linear leaves are not supported")
        leaves = int(kv["num_leaves"])
        arr = lambda k, f, kv=kv: np.array([f(v) for v in kv.get(k, "").split()])
        decision = arr("decision_type", int).astype(np.int64)
        tree = {"feature": arr("split_feature", int).astype(np.int64), "threshold": arr("threshold", float), "left": arr("left_child", int).astype(np.int64), "right": arr("right_child", int).astype(np.int64), "default_left": (decision & 2) != 0, "leaf": arr("leaf_value", float)}
        if (decision & 1).any() or any(len(tree[k]) != leaves - 1 for k in ("feature", "threshold", "left", "right", "default_left")) or len(tree["leaf"]) != leaves:
            raise ValueError("a tree's arrays have wrong lengths")
        model.trees.append(tree)
    return model


def format_ensemble(model: Ensemble) -> str:
    """The text that ``parse_ensemble`` reads."""
    line = lambda k, v: f"{k}={' '.join(map(repr, v.tolist()))}"
    out = [f"tree\nversion=v3\nnum_class={model.classes}\nfeature_names={' '.join(model.features)}\n"]
    for i, t in enumerate(model.trees):
        rows = [f"Tree={i}", f"num_leaves={len(t['leaf'])}", "num_cat=0", line("split_feature", t["feature"]), line("threshold", t["threshold"]), line("decision_type", t["default_left"] * 2), line("left_child", t["left"]), line("right_child", t["right"]), line("leaf_value", t["leaf"]), "is_linear=0"]
        out.append("\n".join(rows) + "\n")
    return "\n".join(out)


def softmax(margin: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = margin / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def score(df: DataFrame, model: Ensemble, temperature: float = 1.0) -> DataFrame:
    """Adds ``p``: class probabilities (one probability for a binary model)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def predict(*cols):
        import pandas as pd

        m = held.value.margins(np.column_stack([c.to_numpy(float) for c in cols]))
        p = softmax(m, temperature) if m.shape[1] > 1 else sigmoid(m)
        return pd.Series(list(p))

    return df.withColumn("p", predict(*[F.col(c).cast("double") for c in model.features]))


def node_table(spark, model: Ensemble) -> DataFrame:
    """(tree, node, feature, threshold, default_left, left, right, leaf): inner nodes from 0, leaf i as -1 - i; ``leaf`` is null at inner nodes."""
    rows = []
    for i, t in enumerate(model.trees):
        rows += [(i, n, int(t["feature"][n]), float(t["threshold"][n]), bool(t["default_left"][n]), int(t["left"][n]), int(t["right"][n]), None) for n in range(len(t["feature"]))]
        rows += [(i, -1 - n, None, None, None, None, None, float(v)) for n, v in enumerate(t["leaf"])]
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, default_left boolean, left int, right int, leaf double")


def walked(df: DataFrame, key: str, model: Ensemble) -> DataFrame:
    """(key, output, margin): the trees as a table, walked by one join a level; what ``Ensemble.margins`` gives, in SQL's terms.

    ``key`` must be unique. A row stands once for each tree, so this is for checking a model and for
    models that live in tables; nodes, which the model bounds, are broadcast.
    """
    nodes = F.broadcast(node_table(df.sparkSession, model))
    depth = max((_depth(t) for t in model.trees), default=0)
    at = df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in model.features]).alias("x"))
    at = at.select("key", "x", F.explode(F.sequence(F.lit(0), F.lit(len(model.trees) - 1))).alias("tree"))
    at = at.join(F.broadcast(df.sparkSession.createDataFrame([(i, 0 if len(t["feature"]) else -1) for i, t in enumerate(model.trees)], "tree int, node int")), "tree")
    for _ in range(depth):
        value = F.get("x", F.col("feature"))
        down = F.when(value.isNull() | F.isnan(value), F.col("default_left")).otherwise(value <= F.col("threshold"))
        at = at.join(nodes, ["tree", "node"]).select("key", "x", "tree", F.when(F.col("leaf").isNotNull(), F.col("node")).when(down, F.col("left")).otherwise(F.col("right")).alias("node"))
    leaves = at.join(nodes, ["tree", "node"]).select("key", (F.col("tree") % model.classes).alias("output"), "leaf")
    return leaves.groupBy("key", "output").agg(F.sum("leaf").alias("margin")).withColumnRenamed("key", key)


def _depth(tree: dict[str, np.ndarray]) -> int:
    """The most inner nodes above a leaf."""
    level, depth = [0] if len(tree["feature"]) else [], 0
    while level:
        depth += 1
        level = [int(c) for n in level for c in (tree["left"][n], tree["right"][n]) if c >= 0]
    return depth


def temperature_slopes(df: DataFrame, margins: str, label: str, beta: float) -> tuple[float, float]:
    """First and second derivative, by the inverse temperature, of the negative log likelihood summed over all rows."""
    m, b = F.col(margins), F.lit(beta)
    top = F.array_max(m)
    weight = F.transform(m, lambda x: F.exp(b * (x - top)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.zip_with(weight, m, lambda w, x: w * x)) / total(weight)
    square = total(F.zip_with(weight, m, lambda w, x: w * x * x)) / total(weight)
    r = df.where(m.isNotNull() & F.col(label).isNotNull()).agg(F.sum(mean - F.element_at(m, F.col(label).cast("int") + 1)).alias("d1"), F.sum(square - mean * mean).alias("d2")).first()
    return r.d1 or 0.0, r.d2 or 0.0


def fit_temperature(df: DataFrame, margins: str, label: str, steps: int = 40, tolerance: float = 1e-9) -> float:
    """The temperature in e**[-2, 2] that gives the labels the greatest likelihood; 1 where all do alike.

    Newton's steps on the inverse temperature, in which the loss is convex, kept
    within the bounds that the slopes so far leave. Each step is one sum over the
    table; no row leaves it. Write a table that is costly to compute.
    """
    lo, hi = math.exp(-2.0), math.exp(2.0)
    if temperature_slopes(df, margins, label, lo)[0] > 0:
        return 1 / lo
    if temperature_slopes(df, margins, label, hi)[0] < 0:
        return 1 / hi
    beta = 1.0
    for _ in range(steps):
        d1, d2 = temperature_slopes(df, margins, label, beta)
        if d1 == 0:
            break
        lo, hi = (beta, hi) if d1 < 0 else (lo, beta)
        step = beta - d1 / d2 if d2 > 0 else lo
        step = step if lo < step < hi else (lo + hi) / 2
        if abs(step - beta) < tolerance:
            return 1 / step
        beta = step
    return 1 / beta


def recency_weight(season: Column, last: int = 2022, decay: float = 0.95) -> Column:
    return F.pow(F.lit(decay), F.greatest(F.lit(0), F.lit(last) - season))


def log_loss(df: DataFrame, p: str = "p_true") -> DataFrame:
    """Mean log loss of the probability given to what happened, clipped at 1e-15."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg(-F.log(F.greatest(F.col(p), F.lit(1e-15)))), 6).alias("log_loss"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10, least: int = 20) -> DataFrame:
    """Bins of a probability with at least ``least`` rows: mean forecast and rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("forecast"), F.round(F.avg(F.col(y).cast("double")), 6).alias("rate"))
    return g.where(F.col("n") >= least)


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10, least: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap")).where(F.col("n") >= least)
    return g.agg(F.round(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), F.lit(0.0)), 6).alias("ece"))


def binary_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """Brier score, log loss, base-rate log loss and ROC AUC by average ranks. One row.

    Ranks come from counts of each distinct score, summed in order over ranges of
    scores, so equal scores share their rank and no task sees all of them.
    """
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    yy = F.col(y).cast("double")
    base = df.agg(F.count("*").alias("n"), F.sum(yy).alias("pos"), F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier"), F.avg(-(yy * F.log(q) + (1 - yy) * F.log(1 - q))).alias("ll"))
    g = df.groupBy(F.col(p).alias("s")).agg(F.count("*").alias("c"), F.sum(yy).alias("pc"))
    ranks = in_order(g, "s", sums=("c",)).select(F.col("pc"), (F.col("before_c") + (F.col("c") + 1) / 2).alias("rank")).agg(F.sum(F.col("pc") * F.col("rank")).alias("r"))
    neg = F.col("n") - F.col("pos")
    auc = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    rate = F.col("pos") / F.col("n")
    return base.crossJoin(ranks).select("n", F.round("brier", 6).alias("brier"), F.round("ll", 6).alias("log_loss"), F.round(-(rate * F.log(rate) + (1 - rate) * F.log(1 - rate)), 6).alias("base_log_loss"), F.round(auc, 6).alias("auc"))


def chase_rules(p: Column, need: Column, balls: Column, wickets: Column) -> Column:
    """A win probability with what is certain put first."""
    return F.when(need <= 0, 1.0).when((balls <= 0) | (wickets <= 0), 0.0).when(need > 6 * balls, 0.0).otherwise(p)


#: The point that a sweep starts from, each feature's first and last value and step, and the direction that the probability must take.
SWEEP_BASE = {"need": 60, "balls": 60, "wickets": 6}
SWEEPS = {"need": (1, 159, 2, False), "balls": (1, 119, 2, True), "wickets": (1, 10, 1, True)}


def monotone_sweeps(spark) -> DataFrame:
    """(feature, value, rising, need, balls, wickets): each feature swept with the others at the base point."""
    out = None
    for name, (lo, hi, by, rising) in SWEEPS.items():
        v = spark.range(lo, hi + 1, by).select(F.lit(name).alias("feature"), F.col("id").alias("value"), F.lit(rising).alias("rising"))
        v = v.select("*", *[(F.col("value") if c == name else F.lit(x).cast("bigint")).alias(c) for c, x in SWEEP_BASE.items()])
        out = v if out is None else out.unionByName(v)
    return out


def sweep_violations(sweeps: DataFrame, p: str) -> DataFrame:
    """(feature, rising, violations) of a probability over ``monotone_sweeps``."""
    step = F.col(p) - F.lag(p).over(W.partitionBy("feature", "rising").orderBy("value"))
    wrong = F.when(F.col("rising"), step < -1e-12).otherwise(step > 1e-12)
    return sweeps.select("feature", "rising", wrong.alias("wrong")).groupBy("feature", "rising").agg(F.count_if("wrong").alias("violations"))


# -- distributions in array columns


def tilt(p: Column, values: Column, strength: Column) -> Column:
    """p * exp(strength * value), normalised; p itself where nothing is left."""
    w = F.zip_with(p, values, lambda a, v: a * F.exp(strength * v))
    z = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    return F.when((strength == 0) | (z <= 0), p).otherwise(F.transform(w, lambda a: a / z))


def apply_intent(p: Column, intent: Column, required: Column, values: Column) -> Column:
    """An intent's tilt; an attack that need not be one (required below 7) makes wickets likelier and scales the rest."""
    out = tilt(p, values, F.when(intent == "block", -0.30).when(intent == "attack", 0.34).otherwise(0.0))
    w = F.least(F.element_at(out, 7) * (1 + 1.8 * (7 - required) / 7), F.lit(1.0))
    rest = F.coalesce(F.try_divide(1 - w, 1 - F.element_at(out, 7)), F.lit(0.0))
    return F.when((intent == "attack") & (required < 7), F.transform(out, lambda a, i: F.when(i == 6, w).otherwise(a * rest))).otherwise(out)


def sample(p: Column, u: Column) -> Column:
    """The first outcome whose cumulative probability exceeds u; the last possible one if rounding leaves none."""
    at = F.aggregate(
        p, F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"), F.lit(-1).alias("last")),
        lambda s, a: F.struct((s["cum"] + a).alias("cum"), (s["i"] + 1).alias("i"), F.when((s["hit"] < 0) & (u < s["cum"] + a), s["i"]).otherwise(s["hit"]).alias("hit"), F.when(a > 0, s["i"]).otherwise(s["last"]).alias("last")),
    )
    return F.when(at["hit"] >= 0, at["hit"]).otherwise(at["last"])


def draw(key: Column, innings: Column, over: Column, ball: Column, choice: Column) -> Column:
    """A number in [0, 1) of 52 bits that only the key and the coordinate decide."""
    h = F.sha2(F.concat_ws("|", key, *[c.cast("string") for c in (innings, over, ball, choice)]), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def encode_choice(bowler: Column, intent_no: Column) -> Column:
    return bowler + intent_no * 16
