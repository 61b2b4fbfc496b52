"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (2 and 3 bytes of letters, word
edges included), weighted ``log(1 + tf) * idf`` and normalised; a language has
``clusters`` centroids from spherical k-means; the nearest centroid by cosine
decides. A text is rejected if it has no letter, or if its cosine to that
centroid is under ``reject_below``; as short texts have few n-grams to match,
the limit falls in proportion for texts of under ``reject_full`` n-grams.

The model is fitted on a bounded sample of labelled rows: up to
``sample_per_lang`` distinct texts a language, chosen by a hash of the text,
which is documented in ``fit``; predictions read every whole text. Null or empty texts
and texts without a letter are ``und`` with score 0. Of equally near centroids
the first by language name decides; repeated rows are judged alike; an empty
table gives no rows; of a long text all n-grams count, and 512 texts' vectors
are held at once, however short they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm import textkit as tk
from seamline.llm.shared import numbered

BITS = 12
DIM = 1 << BITS
UNDETERMINED = "und"
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))  # for 2 and 3 bytes


ROWS = 512  # texts whose vectors are held at once


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of each text: a (texts, DIM) float32 matrix."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros((n, DIM), np.float32)
    low = tk.FOLD[raw]
    letter = tk.LETTER[low]
    gram = np.where(letter, low, np.uint8(32)).astype(np.uint32)
    code, some = gram, letter
    last = np.zeros(len(raw), bool)  # a text's last byte: no n-gram goes on from there
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offsets))
    counts = np.zeros(n << BITS, np.int64)
    for k, m in enumerate(_MULT, start=1):
        if len(code) <= k:
            break
        with np.errstate(over="ignore"):
            gram = (gram[:-1] << np.uint32(8)) | code[k:]
            slot = (gram * m) >> np.uint32(32 - BITS)
        last = last[:-1] | last[1:] if k > 1 else last[:-1]
        some = (some[:-1] | letter[k:]) if k == 1 else (some[:-1] & letter[k:])
        at = np.flatnonzero(some & ~last)
        counts += np.bincount(row[at] | slot[at], minlength=n << BITS)
    return counts.reshape(n, DIM).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroids, DIM), normalised
    owner: np.ndarray  # language of each centroid
    reject_below: float
    reject_full: int

    def similarities(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf) @ self.centroids.T


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit_vectors(counts: np.ndarray, langs: list[str], clusters: int = 4, reject_below: float = 0.12, reject_full: int = 400, seed: int = 7) -> Model:
    languages = sorted(set(langs))
    label = np.array([languages.index(x) for x in langs])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    rng = np.random.default_rng(seed)
    cents, owner = [], []
    for j in range(len(languages)):
        mine = x[label == j]
        c = _kmeans(mine, clusters, rng)
        cents.append(c)
        owner += [j] * len(c)
    return Model(languages, idf, np.concatenate(cents).astype(np.float32), np.array(owner), reject_below, reject_full)


def fit(labelled: DataFrame, sample_per_lang: int = 400, **options) -> Model:
    """Fits on ``sample_per_lang`` distinct texts (columns ``text``, ``lang``) of each language, or all if it has fewer.

    They are those with the smallest hashes, and copies count once: the bound
    holds however often a text occurs, and no language with a text drops out.
    """
    rows = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != ""))
    rows = rows.withColumn("u", F.xxhash64("text", F.lit(5)))
    # each task ranks and cuts its own part before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    least = rows.select("lang", "u").distinct().withColumn("rank", rank).where(F.col("rank") <= sample_per_lang).select("lang", "u")
    chosen = rows.join(F.broadcast(least), ["lang", "u"]).groupBy("lang", "u").agg(F.first("text").alias("text")).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text", rows=ROWS):
                x = features(raw, off).astype(np.uint32)
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "v"])

    got = chosen.mapInArrow(vectors, "lang string, v binary").toArrow().to_pylist()
    if not got:
        return Model([], np.ones(DIM, np.float32), np.zeros((1, DIM), np.float32), np.zeros(1, int), 0.0, 1)
    got.sort(key=lambda r: (r["lang"], r["v"]))
    return fit_vectors(np.stack([np.frombuffer(r["v"], np.uint32) for r in got]).astype(np.float32), [r["lang"] for r in got], **options)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` plus, under ``names``, the language, its score (double, cosine, 0 to 1) and whether the text is rejected.

    A model that has learnt nothing calls every text ``und``, and rejects those without a letter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen, fields = numbered(docs, keep, *([] if "text" in keep else [F.col("text")]), has_letter(F.col("text")))
    source = chosen.columns[keep.index("text") if "text" in keep else len(keep)]
    schema = T.StructType([*fields, *[T.StructField(f"_{n}", t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            at, score, size = np.empty(batch.num_rows, int), np.empty(batch.num_rows), np.empty(batch.num_rows)
            for lo, hi, raw, off in tk.column_chunks(batch, source, rows=ROWS):
                x = features(raw, off)
                sim = m.similarities(x)
                size[lo:hi] = x.sum(axis=1)
                best = sim.argmax(axis=1)
                at[lo:hi], score[lo:hi] = m.owner[best], sim[np.arange(hi - lo), best]
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            rejected = ~letter | (score < m.reject_below * np.minimum(1.0, size / m.reject_full))
            unknown = ~letter if m.languages else np.full(len(letter), True)
            at[unknown], score[unknown] = len(m.languages), 0.0
            score = np.clip(score, 0.0, 1.0)
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(names[at], pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return chosen.mapInArrow(predict, schema).toDF(*keep, *names)
