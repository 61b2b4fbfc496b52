"""Toxicity scores from positive and unlabelled texts, by non-negative PU learning.

A linear classifier over the presence of words is trained in numpy on the risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` (logistic loss): toxic examples
count as positives, every other text is only unlabelled, and the class prior
``pi`` takes the positives hidden among the unlabelled out of the negative
risk; where the corrected risk falls below zero the step goes the other way.

The fit uses a bounded sample (``max_positive``, ``max_unlabelled`` distinct texts
at most, by a hash of the text; copies count once); scoring reads every whole text. Words are runs of letters,
ASCII lower-cased. Null and empty texts have no words: their score is that of
the bias alone. Without a positive example every score is 0. Repeated rows are
scored alike, and of equally telling words the one with the lower hash bucket is
kept; an empty table gives no rows. Long texts are read whole, a chunk at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm import textkit as tk
from seamline.llm.shared import numbered

BITS = 20


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word."""
    w = tk.Words(raw, offsets, keep=tk.LETTER)
    return w.doc(), (w.hash >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    slot: np.ndarray  # feature of each bucket, -1 for none
    weight: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, bucket = buckets(raw, offsets)
        feature = self.slot[bucket]
        at = feature >= 0
        pair = np.unique(row[at] * len(self.weight) + feature[at])
        z = np.bincount(pair // len(self.weight), self.weight[pair % len(self.weight)], n) + self.bias
        return np.where(z < -700, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk (Adam, whole sample each step)."""
    w = np.zeros(pos.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (pos, unl))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = prior * (p.T @ (sp - 1)) / len(p)  # of pi * R_p(+)
        g_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _presence(docs: list[np.ndarray], slot: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(docs), n), np.float32)
    for i, d in enumerate(docs):
        f = slot[d]
        x[i, f[f >= 0]] = 1
    return x


def fit(train: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 6000, features: int = 512) -> Model:
    """Fits on texts of ``train`` (doc_id, text); ``labels`` (doc_id, toxic) of those rows only.

    The prior is the share of toxic rows among the labelled ones. Each sample
    is of the distinct texts with the least hashes.
    """
    sizes = labels.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count("toxic").alias("n")).first()
    if not sizes.p:
        return Model(np.full(1 << BITS, -1, np.int64), np.zeros(1), -1e9)
    prior = min(0.95, sizes.p / sizes.n)

    def least(hashes: DataFrame, limit: int, flag: str) -> DataFrame:
        return hashes.select("u").distinct().orderBy("u").limit(limit).withColumn(flag, F.lit(True))

    rows = train.select("doc_id", "text").where(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("u", F.xxhash64("text", F.lit(9)))
    toxic = rows.select("doc_id", "u").join(labels.where(F.col("toxic") == 1).select("doc_id").distinct(), "doc_id")
    # max_positive + max_unlabelled hashes at most: a table that may be sent to all tasks
    chosen = least(toxic, max_positive, "pos").join(least(rows, max_unlabelled, "unl"), "u", "full")
    sample = rows.join(F.broadcast(chosen), "u").groupBy("u", "pos", "unl").agg(F.first("text").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text"):
                row, bucket = buckets(raw, off)
                pair = np.unique((row << BITS) | bucket)
                cut = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
                got = [(pair[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.record_batch([batch.column("pos").slice(lo, hi - lo), batch.column("unl").slice(lo, hi - lo), pa.array(got, pa.binary())], names=["pos", "unl", "v"])

    got = sorted(sample.select("pos", "unl", "text").mapInArrow(words, "pos boolean, unl boolean, v binary").toArrow().to_pylist(), key=lambda r: (r["v"], bool(r["pos"]), bool(r["unl"])))
    vec = lambda name: [np.frombuffer(r["v"], np.int32) for r in got if r[name]]
    pos, unl = vec("pos"), vec("unl")
    if not pos or not unl:
        return Model(np.full(1 << BITS, -1, np.int64), np.zeros(1), -1e9)
    df_p, df_u = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (pos, unl))
    share_p, share_u = (df_p + 0.5) / len(pos), (df_u + 0.5) / len(unl)
    lift = np.where(df_p >= 2, share_p * np.log(share_p / share_u), -np.inf)
    best = np.argsort(-lift, kind="stable")[:features]
    best = best[lift[best] > 0]
    if not len(best):
        return Model(np.full(1 << BITS, -1, np.int64), np.zeros(1), -1e9)
    slot = np.full(1 << BITS, -1, np.int64)
    slot[best] = np.arange(len(best))
    weight, bias = train_nnpu(_presence(pos, slot, len(best)), _presence(unl, slot, len(best)), prior)
    return Model(slot, weight, bias)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus ``score`` double and ``predicted`` int."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen, fields = numbered(docs, keep, F.col("text"))
    source = chosen.columns[-1]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = [m.score(raw, off) for _, _, raw, off in tk.column_chunks(batch, source)]
            s = np.concatenate(got) if got else np.empty(0)
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*keep, "score", "predicted")
