"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, ASCII lower-cased. A window of ``SPAN``
words falls into four interleaved groups of three positions; each of the six
fixed masks keeps two groups and ignores the other six positions, so that of
any two substituted words at least one mask ignores both. Hashes of training
windows first meet a bitmap of the benchmark's hashes, whose size is fixed;
what passes is joined with the benchmark's windows and compared word by word: a
hit has at least ``SPAN - substitutions`` equal words. Every such window is a
hit, so windows on one diagonal (document position minus item position) that
overlap or touch make one verified run, and a gap between them ends it. Items of
fewer than ``SPAN`` words are searched whole and without substitutions.

Null and empty texts have no windows. Repeated rows give their pairs once, and
of equally long runs one counts. Long texts are read whole, a long one alone. An
empty table or benchmark gives no rows. Rows without a doc_id are told together
in ``find_overlaps``; ``clean`` goes by the text and drops them where they are
contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import textkit as tk
from seamline.llm.shared import fresh_names, written

SPAN = 12
GROUPS = 4
MASKS = list(combinations(range(GROUPS), 2))
SUBSTITUTIONS = 2
BITMAP_BITS = 24
#: Benchmark windows up to this count are sent to every task (about 150 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000

WORD = tk.LETTER.copy()
WORD[48:58] = True


def _windows(h: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Start words of the windows of ``span`` words within one text."""
    n = len(h) - span + 1
    return np.flatnonzero(doc[:n] == doc[span - 1 :]) if n > 0 else np.empty(0, np.int64)


def seed_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(windows, masks): the hash of the kept positions under each mask."""
    weights = tk.seeds(SPAN, 60) | np.uint64(1)
    with np.errstate(over="ignore"):
        group = [sum(h[at + p] * weights[p] for p in range(g, SPAN, GROUPS)) for g in range(GROUPS)]
        return np.stack([tk.mix64(group[a] + group[b] + np.uint64(k)) for k, (a, b) in enumerate(MASKS)], axis=1) if len(at) else np.empty((0, len(MASKS)), np.uint64)


def whole_hashes(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    weights = tk.seeds(SPAN, 61) | np.uint64(1)
    with np.errstate(over="ignore"):
        return tk.mix64(sum((h[at + p] * weights[p] for p in range(span)), np.full(len(at), span, np.uint64)))


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    return h & mask, (h >> np.uint64(BITMAP_BITS)) & mask


def _rows(h: np.ndarray, pos: np.ndarray, hashes: np.ndarray, span: int) -> list[pa.Array]:
    words = h[pos[:, None] + np.arange(span)].view(np.int64).ravel()
    return [pa.array(hashes.view(np.int64)), pa.ListArray.from_arrays(np.arange(len(pos) + 1, dtype=np.int32) * span, pa.array(words))]


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, item_pos, words, item_words) for each item, window and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "words", "item_id", "item_pos", "item_words"]
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text"):
                w = tk.Words(raw, off, keep=WORD)
                doc, count = w.doc(), np.diff(w.first)
                ids = batch.column(0).slice(lo, hi - lo)
                at = _windows(w.hash, doc, SPAN)
                sets = [(np.repeat(at, len(MASKS)), seed_hashes(w.hash, at).ravel(), SPAN)]
                for n in range(1, SPAN):
                    short = w.first[:-1][count == n]
                    sets.append((short, whole_hashes(w.hash, short, n), n))
                for pos, hashes, n in sets:
                    d = doc[pos]
                    cols = _rows(w.hash, pos, hashes, n)
                    yield pa.record_batch([*cols, ids.take(pa.array(d)), pa.array(pos - w.first[d]), pa.array(count[d].astype(np.int64))], names=names)

    return benchmark.select("item_id", "text").mapInArrow(run, "h long, words array<long>, item_id long, item_pos long, item_words long")


def equal_words(x: Column, y: Column) -> Column:
    """Positions at which windows of one length agree, 0 for other lengths; no Python, so that a task of this join has one worker."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, hit: n + hit)
    return F.when(F.size(x) == F.size(y), same).otherwise(F.lit(0))


def longest_run(starts: Column, span: Column) -> Column:
    """Words of the longest stretch that windows of ``span`` words at the sorted ``starts`` cover without a gap."""
    zero = F.lit(0).cast("long")

    def grow(acc: Column, p: Column) -> Column:
        begin = F.when(p <= acc["end"], acc["begin"]).otherwise(p)
        return F.struct(begin.alias("begin"), (p + span).alias("end"), F.greatest(acc["best"], p + span - begin).alias("best"))

    return F.aggregate(starts, F.struct(zero.alias("begin"), zero.alias("end"), zero.alias("best")), grow, lambda acc: acc["best"])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, overlap_words, item_words, coverage) for each document that holds a passage of an item.

    ``overlap_words`` is the longest run of words along a diagonal that verified
    windows cover without a gap, ``coverage`` its share of the item.
    """
    spark = docs.sparkSession
    tests = written(_benchmark_windows(benchmark), "benchmark")
    a, b = (F.shiftright(F.col("h"), k).bitwiseAND((1 << BITMAP_BITS) - 1) for k in (0, BITMAP_BITS))
    bits = tests.select(F.explode(F.array(F.struct(F.lit(0).alias("probe"), a.alias("s")), F.struct(F.lit(1).alias("probe"), b.alias("s")))).alias("x")).select("x.*")
    got = bits.groupBy("probe", F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros((2, 1 << (BITMAP_BITS - 6)), np.int64)
    bitmap[got["probe"].to_numpy(), got["w"].to_numpy()] = got["v"].to_numpy()
    spans = sorted(r.item_words for r in tests.where(F.col("item_words") < SPAN).select("item_words").distinct().collect())  # under SPAN values
    held = spark.sparkContext.broadcast((bitmap.view(np.uint64), spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, short = held.value

        def passes(h: np.ndarray) -> np.ndarray:
            ok = np.ones(h.shape, bool)
            for m, s in zip(maps, _probes(h), strict=True):
                ok &= (m[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
            return ok

        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text"):
                w = tk.Words(raw, off, keep=WORD)
                doc = w.doc()
                ids = batch.column(0).slice(lo, hi - lo)
                at = _windows(w.hash, doc, SPAN)
                hashes = seed_hashes(w.hash, at)
                i, k = np.nonzero(passes(hashes))
                sets = [(at[i], hashes[i, k], SPAN)]
                for n in short:
                    at = _windows(w.hash, doc, n)
                    hashes = whole_hashes(w.hash, at, n)
                    ok = passes(hashes)
                    sets.append((at[ok], hashes[ok], n))
                for pos, hashes, n in sets:
                    if len(pos):
                        cols = _rows(w.hash, pos, hashes, n)
                        yield pa.record_batch([*cols, ids.take(pa.array(doc[pos])), pa.array(pos - w.first[doc[pos]])], names=["h", "doc_words", "doc_id", "doc_pos"])

    hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h long, doc_words array<long>, doc_id long, doc_pos long")

    joined = hits.join(F.broadcast(tests) if tests.count() <= BROADCAST_WINDOWS else tests, "h")
    size = F.least(F.col("item_words"), F.lit(SPAN))
    need = F.when(F.col("item_words") < SPAN, F.col("item_words")).otherwise(F.lit(SPAN - substitutions))
    # of a diagonal the positions that hit, an item's words at most, folded in each task before the shuffle
    hit = joined.where(equal_words(F.col("doc_words"), F.col("words")) >= need).groupBy("doc_id", "item_id", "item_words", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set("item_pos").alias("at"))
    longest = hit.select("doc_id", "item_id", "item_words", longest_run(F.array_sort("at"), size).alias("run"))
    out = longest.groupBy("doc_id", "item_id", "item_words").agg(F.max("run").alias("overlap_words"))
    return out.select("doc_id", "item_id", "overlap_words", "item_words", (F.col("overlap_words") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no passage of the benchmark was found, all columns; rows are told by a 64-bit hash of their text."""
    tag = fresh_names(docs.columns, "_tag")[0]
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    dirty = find_overlaps(tagged.select(F.col(tag).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(tag)).distinct()
    return tagged.join(dirty, tag, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
