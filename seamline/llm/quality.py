"""Quality scores by kernel ridge regression over document statistics.

Every whole text is read once, for ``NAMES``: lengths, shares of kinds of bytes,
words and lines, and how much of it repeats. The statistics, standardised by their
mean and deviation over all documents, go through random Fourier features, whose
products approximate a Gaussian kernel. Each task sums the normal equations of its
labelled rows, by fold; the sums of all tasks (a row of the matrix a key) give the
ridge weights. The ridge parameter is the one with the least squared error on the
folds left out, which the sums tell without another pass. Isotonic regression then
turns scores into shares of good texts: each labelled row is scored by the weights
of the other folds, rows are counted in ``BINS`` bins, and neighbours that fall are
pooled; between pools the share is interpolated, and a thousandth of the score is
the raw one, so that it still orders rows within a pool.

All labelled rows are learned from, none is sampled. What goes to the driver is
``features`` squared sums a fold and ``BINS`` counts, whatever the input. Copies of
a text are in one fold and score alike. Words stand between ASCII white space, A-Z
lower-cased; letters are those of ASCII and all other characters. Null and empty
texts have statistics of zero and are scored by them. Of several labels of one
doc_id the mean counts; null labels and rows without doc_id teach nothing, but are
scored. Without any label every score is 0.5. An empty table gives no rows.
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
from seamline.llm.shared import fresh_names, numbered, written

CHUNK_BYTES = 2 << 20
FOLDS, BINS, SUM_PARTS = 4, 4096, 16
#: Raw scores within these are told apart by the calibration.
LOW, HIGH = -0.5, 1.5
BLEND = 1e-3
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)

NAMES = [
    "log_bytes", "log_words", "log_lines",
    "upper", "other_bytes", "digits", "spaces", "ends", "marks", "symbols",
    "word_length", "word_spread", "long_words",
    "distinct_words", "top_word", "same_as_last", "distinct_pairs", "word_entropy",
    "no_letter_words", "shouted_words", "symbol_words",
    "line_length", "repeated_lines", "ended_lines", "words_an_end",
]


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, END, MARK = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind(".!?"), _kind(",;:'\"()-")
OTHER = np.arange(256) >= 128
LINE = _kind("\n")
SYMBOL = ~(tk.LETTER | DIGIT | END | MARK | tk.SPACE)


def document_statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    n, size = len(off) - 1, np.diff(off)
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=np.asarray(of) > 0)

    def within(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return np.diff(total[first])

    w = tk.Words(raw, off)
    words, doc, length = np.diff(w.first), w.doc(), w.end - w.start
    per_word = lambda kind: within(kind[raw], np.append(w.start, len(raw))) if len(w) else np.zeros(0, np.int64)  # noqa: E731  (space after a word is of no kind below)
    mean = share(np.bincount(doc, length, n), words)
    spread = np.sqrt(np.maximum(share(np.bincount(doc, length.astype(float) ** 2, n), words) - mean**2, 0))
    letters, upper, lower, symbols = (per_word(k) for k in (tk.LETTER, UPPER, tk.LETTER & ~UPPER & ~OTHER, SYMBOL))

    def distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many distinct, the count of the most frequent, sum of count x log count) of each row."""
        order = np.lexsort((h, rows))
        r, x = rows[order], h[order]
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]) if len(r) else np.empty(0, np.int64)
        c = np.diff(np.append(new, len(r)))
        most = np.zeros(n, np.int64)
        np.maximum.at(most, r[new], c)
        return np.bincount(r[new], minlength=n), most, np.bincount(r[new], c * np.log(c), n)

    kinds, most, c_log_c = distinct(doc, w.hash)
    inner = doc[1:] == doc[:-1] if len(w) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pair = tk.mix64(w.hash[:-1] * np.uint64(3) + w.hash[1:])[inner] if len(w) else np.empty(0, np.uint64)
    pairs = np.maximum(words - 1, 0)
    same = np.bincount(doc[1:][inner & (w.hash[1:] == w.hash[:-1])], minlength=n) if len(w) else np.zeros(n)

    lines = tk.Words(raw, off, keep=~LINE, fold=False)
    count, at = np.diff(lines.first), lines.doc()
    last = raw[lines.end - 1] if len(lines) else np.empty(0, np.uint8)
    ends = within(END[raw], off)
    log_words = np.log(np.maximum(words, 1))
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(count),
        *(share(within(k[raw], off), size) for k in (UPPER, OTHER, DIGIT, tk.SPACE, END, MARK, SYMBOL)),
        mean, spread, share(np.bincount(doc[length > 20], minlength=n), words),
        share(kinds, words), share(most, words), share(same, pairs), share(distinct(doc[1:][inner] if len(w) else doc, pair)[0], pairs), share(log_words - share(c_log_c, words), log_words),
        *(share(np.bincount(doc[k], minlength=n), words) for k in (letters == 0, (upper >= 2) & (lower == 0), (symbols > 0) & (letters > 0))),
        np.log1p(share(np.bincount(at, lines.end - lines.start, n), count)), 1 - share(distinct(at, lines.hash)[0], np.maximum(count, 1)) - (count == 0), share(np.bincount(at[END[last]], minlength=n), count), np.log1p(share(words, np.maximum(ends, 1))),
    ], axis=1)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then the statistics (array<float>) and the fold, which copies of a text share."""
    chosen, fields = numbered(docs, keep, F.col("text"), F.pmod(F.xxhash64("text", F.lit(29)), F.lit(FOLDS)).cast("int"))
    source, fold = chosen.columns[-2:]
    schema = T.StructType([*fields, T.StructField("stats", T.ArrayType(T.FloatType())), T.StructField("fold", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, source, CHUNK_BYTES):
                x = document_statistics(raw, off).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.record_batch([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), lists, batch.column(batch.schema.get_field_index(fold)).slice(lo, hi - lo)], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*keep, *fresh_names(keep, "stats", "fold"))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray  # (statistics, features)
    phase: np.ndarray
    weights: np.ndarray  # (FOLDS + 1, features + 1): without fold k, and at the end of all
    knots: np.ndarray
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        out = np.ones((len(x), self.waves.shape[1] + 1))
        out[:, :-1] = np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phase)
        return out

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        score = np.clip(score, LOW, HIGH)
        return (1 - BLEND) * np.interp(score, self.knots, self.shares) + BLEND * (score - LOW) / (HIGH - LOW)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pooled(score: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: (mean score, share of good) of each pool; ``score`` rises."""
    pools: list[list[float]] = []
    for s, n, g in zip(score * total, total, good, strict=True):
        pools.append([s, n, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def normal_equations(labelled: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(F'F, F'y, y'y) of each fold, over all rows of (stats, fold, y); F has a last feature of one."""
    held = labelled.sparkSession.sparkContext.broadcast(model)
    width = model.waves.shape[1] + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = held.value, {}
        for batch in batches:
            x, fold, y = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(fold):
                f = np.column_stack([m.features(x[fold == k]), y[fold == k]])  # y is one more feature: its products are F'y and y'y
                sums[k] = sums.get(k, 0) + f.T @ f
        for k, s in sums.items():
            yield pa.record_batch([pa.array([k] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array([s[i, i:].tobytes() for i in range(len(s))], pa.binary())], names=["fold", "i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k, i] = sums.get((k, i), 0) + np.frombuffer(v)
        yield pa.record_batch([pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["fold", "i", "v"])

    kinds = "fold int, i int, v binary"
    rows = labelled.select("stats", "fold", "y").mapInArrow(part, kinds).repartition(SUM_PARTS, "fold", "i").mapInArrow(add, kinds).toArrow()
    held.unpersist()
    out = np.zeros((FOLDS, width + 1, width + 1))
    for k, i, v in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        out[k, i, i:] = out[k, i:, i] = np.frombuffer(v)
    return [(s[:-1, :-1], s[:-1, -1], s[-1, -1]) for s in out]


def ridge(a: np.ndarray, b: np.ndarray, strength: float) -> np.ndarray:
    """The penalty grows with the rows (the last feature is one, so its square sum is their number) and spares the constant."""
    penalty = np.full(len(b), strength * max(a[-1, -1], 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 3.0, seed: int = 5) -> Model:
    """``stats`` is ``statistics`` of all documents with doc_id, written; ``labels`` (doc_id, quality) are those to learn from.

    ``width`` is that of the Gaussian kernel, in deviations of a statistic.
    """
    d = len(NAMES)
    rng = np.random.default_rng(seed)
    moments = stats.agg(*[f(F.col("stats")[i].cast("double")).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(d)]).first()
    mean, spread = (np.array([moments[f"{n}{i}"] or 0.0 for i in range(d)]) for n in "ms")
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros((FOLDS + 1, features + 1)), np.array([LOW, HIGH]), np.array([0.5, 0.5]))
    model.weights[:, -1] = 0.5
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    labelled = written(stats.select("doc_id", "stats", "fold").join(truth, "doc_id").select("stats", "fold", "y"), "labelled")
    sums = normal_equations(labelled, model)
    total = tuple(sum(s[i] for s in sums) for i in range(3))
    if not total[0][-1, -1]:
        return model

    def left_out(strength: float) -> tuple[float, list[np.ndarray]]:
        w = [ridge(total[0] - a, total[1] - b, strength) for a, b, _ in sums]
        return sum(yy - 2 * v @ b + v @ a @ v for v, (a, b, yy) in zip(w, sums, strict=True)), w

    strength = min(RIDGES, key=lambda s: left_out(s)[0])
    model.weights = np.array([*left_out(strength)[1], ridge(total[0], total[1], strength)])
    model.knots, model.shares = calibration(labelled, model)
    return model


def calibration(labelled: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            fold, y = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = (m.features(_matrix(batch.column(0))) * m.weights[fold]).sum(axis=1)
            at = ((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1)).astype(np.int64)
            n, good = np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(n[used].astype(np.int64)), pa.array(good[used])], names=["bin", "n", "good"])

    rows = sorted(labelled.mapInArrow(run, "bin int, n long, good double").groupBy("bin").agg(F.sum("n"), F.sum("good")).collect())
    held.unpersist()
    at, n, good = (np.array([r[i] for r in rows], float) for i in range(3))
    return pooled(LOW + (at + 0.5) * (HIGH - LOW) / (BINS - 1), n, good)


def score(stats: DataFrame, model: Model, keep: list[str], least: float = 0.3) -> DataFrame:
    """Columns ``keep`` of ``statistics`` plus ``score`` double and ``predicted`` int (1 if score >= ``least``)."""
    held = stats.sparkSession.sparkContext.broadcast(model)
    chosen, fields = numbered(stats, keep, F.col("stats"))
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = m.calibrated(m.features(_matrix(batch.column(len(keep)))) @ m.weights[-1])
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= least).astype(np.int32))], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*keep, "score", "predicted")
