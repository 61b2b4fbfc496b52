"""Gradient boosting over histograms, for one probability or several classes, with monotone features.

Rows are binned once: a feature's cuts are its values where they are few, else
quantiles over the rows to fit on. A level of all trees of a round is one job: each
task walks its binned rows down the trees so far and sums gradients by class, node,
feature and bin; sums are partial before their shuffle, and what reaches the driver
is bounded by classes x nodes x features x bins. Only left children are summed, a
right child is its parent less its sibling. Gradients are whole numbers of
1 / ``UNIT``, so sums are exact whatever the partitions, and a task that is run again
adds the same.

A split of a feature that must rise (or fall) may not order its children's values
the other way, and the middle of the two bounds what stands below either: so each
tree is monotone, and so is their sum. Margins are written every ``keep`` rounds, and
trees since then are walked anew. Rounds end early when the loss on the rows held
out has not fallen for ``patience`` rounds; the best round's trees are kept.

A null or NaN feature goes with the lowest values. Rows with a null label are left
out; a null weight is 1. Without a row to fit on every margin is the prior's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators.models import Ensemble, softmax
from seamline.session import written

UNIT = 1 << 24


@dataclass
class Grown:
    """A tree over bins: node 0 is the root; ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    bounds: list[tuple[float, float]] = field(default_factory=lambda: [(-math.inf, math.inf)])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(live):
            k = node[live]
            node[live] = np.where(bins[live, feature[k]] <= at[k], left[k], right[k])
            live = live[feature[node[live]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Options:
    classes: int = 2
    rounds: int = 50
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    least: int = 20
    bins: int = 64
    patience: int = 10
    keep: int = 5
    monotone: dict[str, int] = field(default_factory=dict)

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes


@dataclass
class Fitted:
    model: Ensemble
    trees: list[list[Grown]]
    losses: list[float]  # on the rows held out (or, without any, on those to fit on), before each round and after the last
    edges: list[np.ndarray]
    prior: np.ndarray
    best: int


def cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Rising cuts of each feature: all its values where they are few, else quantiles. A value goes to the first cut that is not below it."""
    value = lambda f: F.nullif(F.col(f).cast("double"), F.lit(math.nan))
    places = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    row = df.agg(*[x for i, f in enumerate(features) for x in (F.percentile_approx(value(f), places, 10000).alias(f"q{i}"), F.approx_count_distinct(value(f), 0.02).alias(f"n{i}"))]).first()
    few = [i for i in range(len(features)) if row[f"n{i}"] < 0.9 * bins]
    # so few values that they may be collected
    every = df.agg(*[F.collect_set(value(features[i])).alias(f"v{i}") for i in few]).first() if few else {}
    return [np.unique(np.array((sorted(every[f"v{i}"])[:-1] if i in few else row[f"q{i}"]) or [], float)) for i in range(len(features))]


def binned(df: DataFrame, features: list[str], label: str, weight: str | None, held_out: str | None, edges: list[np.ndarray]) -> DataFrame:
    """(x binary, a byte a feature; y int; w double; held boolean)."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.zeros((n, len(edges)), kind)
            for i, e in enumerate(edges):
                v = batch.column(3 + i).to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(e, v))
            size = len(edges) * x.itemsize
            data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * size + 1, max(size, 1), dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.record_batch([data, *batch.columns[:3]], names=["x", "y", "w", "held"])

    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"), (F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)).alias("held"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)).alias(f"f{i}") for i, f in enumerate(features)],
    )
    return rows.mapInArrow(run, "x binary, y int, w double, held boolean")


def _read(batch: pa.RecordBatch, n_bins: int) -> np.ndarray:
    """The bins of a batch."""
    column, n = batch.column(0), batch.num_rows
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint8 if n_bins <= 256 else np.uint16).reshape(n, -1)


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, loss) of each row; g and h for each output."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        true = y[:, None] == 1
        at = np.where(true, p, 1 - p)[:, 0]
    else:
        p = softmax(margin)
        true = y[:, None] == np.arange(margin.shape[1])
        at = p[np.arange(len(y)), y]
    return w[:, None] * (p - true), w[:, None] * p * (1 - p), -w * np.log(np.maximum(at, 1e-15))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT)


def _level(rows: DataFrame, done: list[list[Grown]], now: list[Grown], slots: list[dict[int, int]], shape: tuple[int, int], losses: bool) -> tuple[np.ndarray, dict[bool, tuple[int, float]]]:
    """Sums (slot, feature, bin, [g, h, rows]) over rows to fit on; and by ``held`` the weighed loss. ``slots`` numbers each output's nodes to sum."""
    outputs, many, (width, n_bins) = len(now), sum(map(len, slots)), shape
    state = rows.sparkSession.sparkContext.broadcast((done, now, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, trees, wanted = state.value
        sums, lost = np.zeros((3, many * width * n_bins), np.int64), np.zeros((2, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, held = _read(batch, n_bins), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            margin = batch.column(4).flatten().to_numpy().reshape(len(y), outputs).copy()
            for grown in before:
                for k, t in enumerate(grown):
                    margin[:, k] += t.values(x)
            g, h, loss = gradients(margin, y, w)
            if losses:
                for i in (0, 1):
                    lost[i] += np.array([_whole(w[held == i]).sum(), _whole(loss[held == i]).sum()]).astype(np.int64)
            fit = ~held.astype(bool)
            x, g, h = x[fit], _whole(g[fit]), _whole(h[fit])
            for k, t in enumerate(trees):
                if not wanted[k]:
                    continue
                slot = np.full(len(t.feature), -1)
                slot[list(wanted[k])] = list(wanted[k].values())
                node = slot[t.nodes(x)]
                on = node >= 0
                at = ((node[on, None] * width + np.arange(width)) * n_bins + x[on]).ravel()
                for i, v in enumerate((g[on, k], h[on, k], None)):
                    sums[i] += np.bincount(at, None if v is None else np.repeat(v, width), sums.shape[1]).astype(np.int64)
        cell = np.flatnonzero(sums[2])
        # two more rows hold weight and loss of the rows to fit on and of those held out
        parts = zip(sums[:, cell], (lost[:, 0], lost[:, 1], np.zeros(2, np.int64)), strict=True)
        yield pa.record_batch([pa.array(np.append(cell, [-1, -2])), *(pa.array(np.append(p, q)) for p, q in parts)], names=["cell", "g", "h", "n"])

    got = rows.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    state.unpersist()
    cell, g, h, n = (got[c].to_numpy() for c in ("cell", "g", "h", "n"))
    lost = {i: next(((int(a), b / UNIT) for c, a, b in zip(cell, g, h, strict=True) if c == -1 - i), (0, 0.0)) for i in (0, 1)}
    out, inside = np.zeros((3, many * width * n_bins), np.int64), cell >= 0
    out[:, cell[inside]] = g[inside], h[inside], n[inside]
    return out.reshape(3, many, width, n_bins).transpose(1, 2, 3, 0), {bool(i): v for i, v in lost.items()}


def best_split(sums: np.ndarray, bounds: tuple[float, float], o: Options, signs: np.ndarray) -> tuple[float, int, int, float, float] | None:
    """(gain, feature, bin, left value, right value) of a node's sums (feature, bin, [g, h, rows]); ties to the lower feature and bin."""
    g, h, n = (np.cumsum(sums[..., i], axis=1) / (UNIT if i < 2 else 1) for i in range(3))
    whole = g[:, -1:], h[:, -1:], n[:, -1:]
    right = [t - c for t, c in zip(whole, (g, h, n), strict=True)]
    value = lambda a, b: np.clip(-a / (b + o.l2), *bounds)
    worth = lambda a, b, v: -(a * v + 0.5 * (b + o.l2) * v * v)
    lv, rv, pv = value(g, h), value(right[0], right[1]), value(whole[0], whole[1])
    gain = worth(g, h, lv) + worth(right[0], right[1], rv) - worth(whole[0], whole[1], pv)
    fine = (n >= max(1, o.least)) & (right[2] >= max(1, o.least)) & (signs[:, None] * (rv - lv) >= 0)
    gain = np.where(fine, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b), float(lv[f, b]), float(rv[f, b])) if gain[f, b] > 1e-9 else None


def _grow(rows: DataFrame, done: list[list[Grown]], o: Options, signs: np.ndarray, shape: tuple[int, int]) -> tuple[list[Grown], dict[bool, tuple[int, float]]]:
    trees = [Grown() for _ in range(o.outputs)]
    slots = [{0: k} for k in range(o.outputs)]
    sums, losses = _level(rows, done, trees, slots, shape, True)
    known = {(k, 0): sums[k] for k in range(o.outputs)}
    for k, t in enumerate(trees):
        g, h = known[k, 0][0].sum(axis=0)[:2] / UNIT
        t.value[0] = -g / (h + o.l2) if known[k, 0][0].sum() else 0.0
    for level in range(o.depth):
        left = []
        for (k, i), s in known.items():
            t = trees[k]
            found = best_split(s, t.bounds[i], o, signs)
            if not found:
                continue
            t.gain[i], t.feature[i], t.bin[i], lv, rv = found
            lo, hi = t.bounds[i]
            mid = (lv + rv) / 2
            sign = signs[t.feature[i]]
            t.left[i], t.right[i] = len(t.feature), len(t.feature) + 1
            for v, b in ((lv, (mid, hi) if sign < 0 else (lo, mid) if sign > 0 else (lo, hi)), (rv, (lo, mid) if sign < 0 else (mid, hi) if sign > 0 else (lo, hi))):
                for name, x in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", v), ("gain", 0.0), ("bounds", b)):
                    getattr(t, name).append(x)
            left.append((k, i))
        if not left or level == o.depth - 1:
            break
        slots = [{} for _ in trees]
        for j, (k, i) in enumerate(left):
            slots[k][trees[k].left[i]] = j
        sums, _ = _level(rows, done, trees, slots, shape, False)
        known = {x: s for j, (k, i) in enumerate(left) for x, s in (((k, trees[k].left[i]), sums[j]), ((k, trees[k].right[i]), known[k, i] - sums[j]))}
    for t in trees:
        t.value = [v * o.rate for v in t.value]
    return trees, losses


def _with_margins(rows: DataFrame, trees: list[list[Grown]], n_bins: int) -> DataFrame:
    state = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _read(batch, n_bins), batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1).copy()
            for grown in state.value:
                for k, t in enumerate(grown):
                    m[:, k] += t.values(x)
            yield pa.record_batch([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def train(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, held_out: str | None = None, options: Options | None = None) -> Fitted:
    """Fits on the rows where the boolean ``held_out`` isn't true; those where it is decide when to stop. Labels are 0 to classes - 1."""
    o = options or Options()
    edges = cuts(df.where(~F.coalesce(F.col(held_out), F.lit(False))) if held_out else df, features, o.bins)
    shape = len(features), max(map(len, edges), default=0) + 1
    rows = written(binned(df, features, label, weight, held_out, edges), "binned")
    share = {r.y: r.w for r in rows.where("NOT held").groupBy("y").agg(F.sum("w").alias("w")).collect()}
    if any(not 0 <= y < o.classes for y in share):
        raise ValueError(f"labels must be 0 to {o.classes - 1}")
    p = np.array([share.get(k, 0.0) for k in range(o.classes)])
    p = np.maximum(p / p.sum() if p.sum() else np.full(o.classes, 1 / o.classes), 1e-6)
    prior = np.array([math.log(p[1] / p[0])]) if o.outputs == 1 else np.log(p)
    rows = rows.withColumn("m", F.array(*[F.lit(float(v)) for v in prior]))
    signs = np.array([o.monotone.get(f, 0) for f in features])
    trees, losses, since = [], [], 0
    best, lowest = 0, math.inf

    def heard(by: dict[bool, tuple[int, float]]) -> None:
        nonlocal best, lowest
        w, lost = by[True] if by[True][0] else by[False]
        losses.append(float(lost / max(w / UNIT, 1e-12)))
        if losses[-1] < lowest - 1e-12:
            best, lowest = len(losses) - 1, losses[-1]

    for _ in range(o.rounds if p.sum() and share else 0):
        grown, by = _grow(rows, trees[since:], o, signs, shape)
        heard(by)
        trees.append(grown)
        if len(losses) - 1 - best >= o.patience:
            break
        if len(trees) - since >= o.keep:
            rows, since = written(_with_margins(rows, trees[since:], shape[1]), "margins"), len(trees)
    else:
        if trees:
            heard(_level(rows, trees[since:], [Grown() for _ in prior], [{} for _ in prior], shape, True)[1])
    return Fitted(_ensemble(trees[:best], features, edges, prior), trees, losses, edges, prior, best)


def _ensemble(trees: list[list[Grown]], features: list[str], edges: list[np.ndarray], prior: np.ndarray) -> Ensemble:
    """In thresholds instead of bins; the prior is in the first round's leaves."""
    out = Ensemble(len(prior), list(features))
    for r, grown in enumerate(trees or [[Grown() for _ in prior]]):
        for k, t in enumerate(grown):
            inner = [i for i, f in enumerate(t.feature) if f >= 0]
            leaves = [i for i, f in enumerate(t.feature) if f < 0]
            name = {i: j for j, i in enumerate(inner)} | {i: -1 - j for j, i in enumerate(leaves)}
            base = prior[k] if r == 0 else 0.0
            # a cut past the last one is never split on, as nothing stands right of it
            out.trees.append({
                "feature": np.array([t.feature[i] for i in inner], np.int64), "threshold": np.array([edges[t.feature[i]][t.bin[i]] for i in inner], float),
                "left": np.array([name[t.left[i]] for i in inner], np.int64), "right": np.array([name[t.right[i]] for i in inner], np.int64),
                "default_left": np.ones(len(inner), bool), "leaf": np.array([base + t.value[i] for i in leaves]),
            })
    return out
