"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. A pass over the texts gives each its set of distinct five-word shingles (64
   bit hashes), a 128-bit fingerprint of that set, MinHash samples, band keys,
   and an odd sketch: the samples folded into a bitmap by parity, so that the
   XOR of two bitmaps counts the samples in which two texts differ. Equal sets
   become one node.
2. Rounds of pivots: each node is held against one pivot, that of another label
   with which it shares most band buckets. A sketch that allows the threshold
   sends the pair on to the full sets, and confirmed links join labels: a group
   of copies, however large, costs a row a node.
3. Buckets that still hold several labels are cut into blocks, and blocks meet
   in pairs except within a bucket's main label. Sketches tell which labels may
   be linked; their nodes meet once more with their full sets. Of what is
   found, a spanning forest of the labels leaves a task.
4. Components of the confirmed links are the answer.

A pair at the threshold shares no band with probability (1 - t**rows)**bands:
6e-11 at 0.85, 5e-8 at 0.8 with the defaults; the sketch's margin is over six
standard deviations. Texts without words have an empty set and are linked with
nothing; fewer than five words make one shingle; nulls count as empty texts; a
row without doc_id takes part but gives no id to others. Repeated rows are
rows of the same node. An empty table gives no rows. A long text is read whole,
and its set stands in blocks of their own size. Equal estimates need no order:
every pair that a sketch allows is settled by its sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import textkit as tk
from seamline.llm.components import connected, relabelled
from seamline.llm.shared import SMALL_BATCH, fresh_names
from seamline.llm.shared import written as _written

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
ROWS_AT_ONCE = 1024  # texts or pairs that a task works on
BLOCK = 512  # rows of a block, and shingles of its sets
BLOCK_SHINGLES = 1 << 20
PIVOT_ROUNDS = 2
TASK_LABELS = 500_000  # that a task remembers
NEED_BITS = 24  # of the bitmap of documents whose sets are needed: 2 MB at most


def written(df: DataFrame, name: str) -> DataFrame:
    return _written(df, name, SMALL_BATCH)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the sorted distinct shingles of text i are ``hashes[cuts[i]:cuts[i + 1]]``."""
    w = tk.Words(raw, offsets)
    n = len(offsets) - 1
    count = np.diff(w.first)
    doc = w.doc()
    h = tk.window_hash(w.hash, SHINGLE, 21)
    whole = doc[: len(h)] == doc[SHINGLE - 1 :] if len(h) else np.empty(0, bool)
    docs, hashes = [doc[: len(h)][whole]], [h[whole]]
    for m in range(1, SHINGLE):  # a short text's whole sequence
        short = np.flatnonzero(count == m)
        if len(short):
            first = w.first[short]
            with np.errstate(over="ignore"):
                v = sum((w.hash[first + k] * (s | np.uint64(1)) for k, s in enumerate(tk.seeds(m, 30 + m))), np.zeros(len(short), np.uint64))
            docs.append(short)
            hashes.append(tk.mix64(v))
    d, x = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    d, x = d[new], x[new]
    return x, np.searchsorted(d, np.arange(n + 1))


def fingerprints(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever its order."""
    size = np.diff(cuts)
    out = np.zeros((len(size), 2), np.uint64)
    some = np.flatnonzero(size)
    for k in range(2):
        if len(some):
            with np.errstate(over="ignore"):
                out[some, k] = np.add.reduceat(tk.mix64(x + np.uint64(k * 77 + 1)), cuts[:-1][some]) + size[some].astype(np.uint64)
    return [r.tobytes() for r in out]


def minhashes(x: np.ndarray, cuts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) uint32; texts without shingles have zeros."""
    size = np.diff(cuts)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), samples), np.uint32)
    if not len(some):
        return out
    at = cuts[:-1][some]
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(tk.seeds(samples, 40), tk.seeds(samples, 41), strict=True)):
            out[some, k] = np.minimum.reduceat(((x * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(mh: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64."""
    keys = np.zeros((len(mh), BANDS), np.uint64)
    s = tk.seeds(ROWS, 50) | np.uint64(1)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys += tk.mix64(mh[:, r::ROWS][:, :BANDS].astype(np.uint64)) * s[r]
        keys += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return tk.mix64(keys).view(np.int64)


def odd_sketches(mh: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 64) uint64: bit j is the parity of the samples that hash to j."""
    n, k = mh.shape
    with np.errstate(over="ignore"):
        slot = (tk.mix64(mh.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) >> np.uint64(1)) % np.uint64(SKETCH_BITS)
    at = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + slot.astype(np.int64)).ravel()
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def most_odd(similarity: float, samples: int = SAMPLES) -> int:
    """The XOR population count expected at a similarity: n/2 * (1 - exp(-4k(1 - J)/n))."""
    return round(SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)))


def least_estimate(threshold: float) -> float:
    return max(0.05, threshold - 6.5 * math.sqrt(threshold * (1 - threshold) / SAMPLES) - 0.03)


def within(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """(rows of a, rows of b) boolean: sketches whose XOR has at most ``limit`` bits."""
    return np.stack([np.bitwise_count(b ^ x).sum(axis=1, dtype=np.int64) <= limit for x in a]) if len(a) else np.zeros((0, len(b)), bool)


def common(sets: list[np.ndarray], rows: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the first ``rows`` sets with the others (with one another if these are all), by products of incidence matrices, some shingles at a time."""
    n = len(sets)
    x, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(x, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # the others are in no intersection
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    others = slice(rows if rows < n else 0, n)
    out = np.zeros((rows, len(range(*others.indices(n)))), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        at = slice(*np.searchsorted(column, [lo, lo + columns]))
        m = np.zeros((n, columns), np.float32)
        m[owner[at], column[at] - lo] = 1
        out += m[:rows] @ m[others].T
    return out.astype(np.int64)


def tree(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the labels that ``linked`` (left rows, right rows) joins: one edge fewer than a tree has labels."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.nonzero(linked)
    i, j = at[i], at[len(left) + j]
    near = np.zeros((len(names), len(names)), bool)
    near[i, j] = near[j, i] = True
    out, free = [], np.ones(len(names), bool)
    for start in np.flatnonzero(near.any(axis=1)):
        queue = [start] if free[start] else []
        free[start] = False
        while queue:
            k = queue.pop()
            hit = np.flatnonzero(near[k] & free)
            free[hit] = False
            out += [(int(names[k]), int(names[h])) for h in hit]
            queue += list(hit)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """Tables of whole groups: runs of rows that agree in the first ``keys`` columns; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        last = held and tuple(held[-1].column(k)[-1].as_py() for k in range(keys))
        if held and last != tuple(c[0] for c in cols):
            yield pa.Table.from_batches(held)
            held = []
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1  # of the last group
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _sketches(column) -> np.ndarray:
    return tk.string_buffers(column)[0].view(np.uint64).reshape(-1, SKETCH_BITS // 64)


def _sets(column) -> list[np.ndarray]:
    raw, off = tk.string_buffers(column)
    return [raw[a:b].view(np.uint64) for a, b in zip(off, off[1:], strict=False)]


def _both(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


class _BySketch:
    """Which rows of a table may be linked."""

    def __init__(self, column, limit: int):
        self.s, self.limit = _sketches(column), limit

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.s[i] ^ self.s[j]).sum(axis=1, dtype=np.int64) <= self.limit

    def blocks(self, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
        return within(self.s[left], self.s[right], self.limit)


class _BySet:
    """Which rows of a table are linked."""

    def __init__(self, column, percent: int):
        self.s, self.percent = _sets(column), percent
        self.size = np.array([len(x) for x in self.s], np.int64)

    def _near(self, both: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= self.percent * (size - both))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(self.size[i], self.size[j]) >= self.percent * np.maximum(self.size[i], self.size[j])
        both = np.array([_both(self.s[x], self.s[y]) if f else 0 for x, y, f in zip(i, j, fits, strict=True)], np.int64)
        return self._near(both, self.size[i] + self.size[j])

    def blocks(self, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
        sets = [self.s[i] for i in left] + ([] if same else [self.s[j] for j in right])
        return self._near(common(sets, len(left)), self.size[left][:, None] + self.size[right][None, :])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_shingles, node, keys, sketch) of every row; tag is a hash of the text, node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, "text", rows=ROWS_AT_ONCE):
                x, cuts = shingle_sets(raw, off)
                size = np.diff(cuts)
                mh = minhashes(x, cuts)
                node = pa.array(fingerprints(x, cuts), pa.binary(), mask=size == 0)
                keys = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * BANDS, pa.array(band_keys(mh).ravel()))
                sketch = pa.array([r.tobytes() for r in odd_sketches(mh)], pa.binary())
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in (0, 2)), pa.array(size.astype(np.int64)), node, keys, sketch], names=["doc_id", "tag", "n_shingles", "node", "keys", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, "doc_id long, tag long, n_shingles long, node binary, keys array<long>, sketch binary")


def _sets_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) for the ``wanted`` (id, doc_id, node): a bitmap of bounded size passes few other rows, the join settles it."""
    slot = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << NEED_BITS))
    words = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(1 << (NEED_BITS - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            s = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(bits[s >> 6] >> (s & 63) & 1 == 1))
            for lo, hi, raw, off in tk.column_chunks(batch, "text"):
                x, cuts = shingle_sets(raw, off)
                first = {f: i for i, f in enumerate(fingerprints(x, cuts))}  # copies in a chunk give one row
                at = list(first.values())
                sets = [x[cuts[i] : cuts[i + 1]].tobytes() for i in at]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(at, pa.int64())), pa.array(list(first), pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "node", "shingles"])

    got = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id long, node binary, shingles binary")
    same = (got.node == wanted.node) & got.doc_id.eqNullSafe(wanted.doc_id)
    # rows that share doc_id and text in different chunks are left to dropDuplicates
    return got.join(wanted, same).select("id", "shingles").dropDuplicates(["id"])


def _alike(pairs: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) of columns a, b, sa, sb whose sketches differ in at most ``limit`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sketches(batch.column(2)), _sketches(batch.column(3))
            fits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of columns a, b, xa, xb whose sets are as near as ``percent`` asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                n = part.num_rows
                both = _BySet(pa.chunked_array([part.column(2), part.column(3)]), percent)
                yield part.select(["a", "b"]).filter(pa.array(both.pairs(np.arange(n), np.arange(n, 2 * n))))

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _pivots(buckets: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of a bucket with two labels or more, and the one pivot of another label with which it shares most buckets.

    A bucket's pivot is the node that a hash of ``turn`` puts first, so nodes
    that share many buckets mostly share one pivot: a row a node leaves this.
    """
    first = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), F.col("id").alias("b"), F.col("label").alias("lb"))).alias("p")
    pivots = buckets.groupBy("key").agg(first, F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    return buckets.join(pivots.select("key", "p.b", "p.lb"), "key").where("label != lb").groupBy(F.col("id").alias("a")).agg(F.mode("b", True).alias("b"))


def _side(nodes: DataFrame, side: str, column: str, name: str) -> DataFrame:
    return nodes.select(F.col("id").alias(side), F.col(column).alias(name))


def _across(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, label, n_shingles) with own, bi, bj: blocks of bounded size, and pairs of blocks wherever labels of a key can meet.

    The label with most rows of a key is its main one. Its rows need not meet
    each other, so its blocks are paired with those of the rest only: where
    few rows are left beside a huge label, rows grow in proportion.
    """
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    main = by_label.groupBy("key").agg(F.max(F.struct("n", "label", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > m.n")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES))).cast("int")
    sized = main.select("key", F.col("m.label").alias("main"), blocks(F.col("m.n"), F.col("m.w")).alias("gm"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("gr"))
    df = rows.join(sized, "key")
    h, is_main = F.xxhash64("id", F.lit(3)), F.col("label") == F.col("main")
    own = F.when(is_main, F.pmod(h, F.col("gm"))).otherwise(F.col("gm") + F.pmod(h, F.col("gr"))).cast("int")
    df = df.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.when(is_main, F.col("gm")).otherwise(F.lit(0)), F.col("gm") + F.col("gr") - 1)))
    return df.select("key", F.least("own", "_other").alias("bi"), F.greatest("own", "_other").alias("bj"), "own", "id", "label")


def _meetings(groups: DataFrame, column: str, judge) -> DataFrame:
    """(a, b): labels that ``judge`` (of the payload ``column``) joins in a group (key, bi, bj, own, id, label, payload)."""
    cols = ["key", "bi", "bj"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups share labels: a task leaves an edge only if its edges before do not imply it
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for t in _grouped(batches):
            key, bi, bj, own, label = (t.column(c).to_numpy() for c in (*cols, "own", "label"))
            cuts = np.append(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]), t.num_rows)
            judged = judge(t.column(column))
            first = cuts[:-1][np.diff(cuts) == 2]  # most groups: no loop for them
            first = first[(label[first] != label[first + 1]) & ((own[first] != own[first + 1]) | (bi[first] == bj[first]))]
            hit = first[judged.pairs(first, first + 1)]
            edges = list(zip(label[hit].tolist(), label[hit + 1].tolist(), strict=True))
            for k in np.flatnonzero(np.diff(cuts) > 2):
                at = np.arange(cuts[k], cuts[k + 1])
                left, right = at[own[at] == bi[at[0]]], at[own[at] == bj[at[0]]]
                apart = label[left][:, None] != label[right][None, :]
                if apart.any():
                    edges += tree(judged.blocks(left, right, bi[at[0]] == bj[at[0]]) & apart, label[left], label[right])
            new = []
            for x, y in edges:
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    new.append((x, y))
            if new:
                yield pa.record_batch([pa.array([e[k] for e in new], pa.int64()) for k in (0, 1)], names=["a", "b"])
            if len(root) > TASK_LABELS:
                root.clear()

    return groups.select(*cols, "own", "id", "label", column).repartition(*cols).sortWithinPartitions(*cols).mapInArrow(each, "a long, b long")


def _labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) of every node, with the labels joined that ``links`` (a, b) between nodes join."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return relabelled(labels, connected(between))


def components(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, tag, n_shingles, label, component_id) of every row; rows with one label belong together, and have the least doc_id of all."""
    limit = most_odd(least_estimate(percent / 100))
    sig = written(signatures(docs), "signatures")
    nodes = sig.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = written(keyed.join(shared, "key"), "buckets")

    # rounds of one candidate a node; what has linked is one label from then on
    labels, sets, now = nodes.select("id", F.col("id").alias("label")), None, buckets.withColumn("label", F.col("id"))
    for turn in range(PIVOT_ROUNDS):
        near = _pivots(now, turn).join(_side(nodes, "a", "sketch", "sa"), "a").join(_side(nodes, "b", "sketch", "sb"), "b")
        near = written(_alike(near, limit), "near")
        sets = _with_sets(docs, nodes, near.select(F.col("a").alias("id")).union(near.select("b")), sets)
        found = near.join(_side(sets, "a", "shingles", "xa"), "a").join(_side(sets, "b", "shingles", "xb"), "b")
        found = written(_linked(found, percent), "links")
        # only labels that differ still meet, so each round has its own links
        labels = written(_labels(labels, found) if turn else relabelled(labels, connected(found)), "labels")
        now = written(buckets.join(labels, "id"), "labelled")

    # what still has several labels in a bucket meets in blocks: first by sketches, then, where those join labels, by full sets
    rows = now.withColumn("n_shingles", F.lit(0))
    met = _meetings(_across(rows).join(nodes.select("id", "sketch"), "id"), "sketch", lambda column: _BySketch(column, limit))
    cluster = connected(written(met, "met")).select(F.col("node").alias("label"), F.col("label").alias("key"))
    active = written(labels.join(cluster, "label").join(nodes.select("id", "n_shingles"), "id"), "active")
    sets = _with_sets(docs, nodes, active.select("id"), sets)
    more = _meetings(_across(active).join(sets, "id"), "shingles", lambda column: _BySet(column, percent))
    final = relabelled(labels, connected(written(more, "links")))

    labelled = written(nodes.select("id", "node", "doc_id").join(final, "id"), "final")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = labelled.join(least, "label").select("node", "label", "component_id")
    out = sig.select("doc_id", "tag", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "tag", "n_shingles", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, have: DataFrame | None) -> DataFrame:
    """``have`` (id, shingles) with the sets of ``ids`` that it lacks."""
    ids = ids.distinct()
    if have is not None:
        ids = ids.join(have.select("id"), "id", "left_anti")
    more = written(_sets_for(docs, written(nodes.select("id", "doc_id", "node").join(ids, "id", "left_semi"), "wanted")), "sets")
    return more if have is None else have.unionByName(more)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two texts are linked if 100 * |A and B| >= percent * |A or B| over their
    shingle sets; component_id is the least doc_id that links reach.
    """
    out = components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the least doc_id. All columns stay.

    A row is told by its doc_id and a hash of its text, so of two texts under
    one doc_id only the duplicate goes; a repeated row stays once; a group
    without any doc_id keeps the text with the least hash.
    """
    names = fresh_names(docs.columns, "_tag")
    found = written(components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent), "near_duplicates")
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("best"))
    grouped = found.join(best, "label")
    gone = grouped.where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag")))).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct()
    twice = written(found.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")), "repeated")
    tagged = docs.withColumn(names[0], F.xxhash64("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def kept(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(keys, df["doc_id"].cast("long").eqNullSafe(keys["_d"]) & (df[names[0]] == keys["_t"]), how)

    left = kept(tagged, gone, "left_anti")
    if twice.isEmpty():
        return left.select(*columns)
    once = kept(left, twice, "left_semi").dropDuplicates(["doc_id", names[0]])
    return kept(left, twice, "left_anti").unionByName(once).select(*columns)
