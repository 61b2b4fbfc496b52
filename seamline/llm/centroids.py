"""Exact integer k-means by kd-tree filtering.

Vectors become integers, ``floor(scale * x)``. Each task cuts its vectors into
blocks of ``BLOCK`` and writes a kd-tree for every block: nodes hold a count,
the integer sums of their vectors and their box, leaves hold ``LEAF`` vectors at
most. A round sends the centroids (k rows) to all blocks and walks each tree
level by level. Of the centroids left at a node, the one nearest to the box's
middle dominates every other that is strictly farther from each point of the
box; those go. A node with one centroid left is counted whole, from its sums; a
leaf with several settles its vectors one by one, ties to the smaller number.
So a round's counts and sums are exactly those of comparing everything, and what
leaves a task is k rows of sums.

All arithmetic is of integers: float64 products where no sum passes 2**53, else
int64. Components beyond ``limit(dims)`` (2**26 for 64) either way are set to it, so
that a squared distance always fits a long; an inertia that does not is null.

Vectors of another length, null, or with a null or non-finite component are left
out, with their rows. A row without an id is clustered like any other but starts
no centroid; repeated rows count each by itself; equal hashes start in the order
of their vectors. With fewer than k vectors there are fewer centroids, an empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import written

BLOCK, LEAF = 8192, 32
TREE = "ids array<long>, points binary, wide boolean, low binary, high binary, sums binary, first binary, last binary, child binary"


def limit(dims: int) -> int:
    """So large that ``dims`` squares of twice as much stay under 2**60."""
    return 1 << 29 - ((dims - 1).bit_length() + 1) // 2


def is_vector(column: Column, dims: int) -> Column:
    """Whether an array has exactly ``dims`` components, none null or non-finite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.coalesce((F.size(column) == dims) & fine, F.lit(False))


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integers) of the vectors of a list column that ``is_vector`` accepts."""
    right = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dims)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.empty((0, dims), np.int32)
    flat = column.filter(right).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)  # a null is nan here
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(x[fine] * scale), -limit(dims), limit(dims)).astype(np.int32)


class Tree:
    """A kd-tree over the rows of ``points``, which it puts in the order of its leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        first, last, child, low, high, sums = [0], [len(points)], [], [], [], []
        i = 0
        while i < len(first):
            s, e = first[i], last[i]
            own = points[order[s:e]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            sums.append(own.sum(axis=0, dtype=np.int64))
            extent = high[-1].astype(np.int64) - low[-1]
            axis = int(extent.argmax())
            if e - s <= leaf or not extent[axis]:
                child.append(-1)
            else:
                half = (e - s) // 2
                order[s:e] = order[s:e][np.argpartition(own[:, axis], half)]
                child.append(len(first))
                first += [s, s + half]
                last += [s + half, e]
            i += 1
        self.order, self.points = order, points[order]
        self.low, self.high, self.sums = np.array(low), np.array(high), np.array(sums)
        self.first, self.last, self.child = (np.array(x, np.int32) for x in (first, last, child))

    def row(self, ids: list) -> list:
        """The values of the columns of ``TREE``."""
        wide = bool(np.abs(self.points.astype(np.int64)).max(initial=0) > 32767)
        kind = np.int32 if wide else np.int16
        return [[ids[j] for j in self.order], self.points.astype(kind).tobytes(), wide, self.low.astype(kind).tobytes(), self.high.astype(kind).tobytes(), self.sums.tobytes(), self.first.tobytes(), self.last.tobytes(), self.child.tobytes()]

    @classmethod
    def read(cls, row: dict, dims: int) -> Tree:
        t, kind = cls.__new__(cls), np.int32 if row["wide"] else np.int16
        t.points, t.low, t.high = (np.frombuffer(row[c], kind).reshape(-1, dims).astype(np.int32) for c in ("points", "low", "high"))
        t.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
        t.first, t.last, t.child = (np.frombuffer(row[c], np.int32) for c in ("first", "last", "child"))
        return t

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
        """Whole nodes as (nodes, their centroid) a level, and (vectors, their centroid) of the leaves with several left."""
        k, whole = len(centroids), []
        most = int(max(np.abs(self.low.astype(np.int64)).max(), np.abs(self.high.astype(np.int64)).max(), np.abs(centroids).max()))
        kind = np.float64 if 8 * most * most * centroids.shape[1] < 1 << 53 else np.int64
        c = centroids.astype(kind)
        square = (c * c).sum(axis=1)
        node, left, settled = np.zeros(1, np.int64), np.ones((1, k), bool), []
        far = np.finfo(np.float64).max if kind is np.float64 else np.iinfo(np.int64).max
        while len(node):
            low, high = self.low[node].astype(kind), self.high[node].astype(kind)
            near = np.where(left, square - (low + high) @ c.T, far).argmin(axis=1)
            for g in np.unique(near):
                at = np.flatnonzero(near == g)
                away = c - c[g]
                # the point of the box that speaks most for another centroid still is strictly nearer to g
                best = high[at] @ np.maximum(away, 0).T + low[at] @ np.minimum(away, 0).T
                left[at] &= ~(square - square[g] - 2 * best > 0)
            single = left.sum(axis=1) == 1
            whole.append((node[single], left[single].argmax(axis=1)))
            node, left = node[~single], left[~single]
            leaf = self.child[node] < 0
            settled.append((node[leaf], left[leaf]))
            node, left = self.child[node[~leaf]].astype(np.int64), left[~leaf]
            node, left = np.concatenate([node, node + 1]), np.concatenate([left, left])
        leaves, masks = np.concatenate([n for n, _ in settled]), np.concatenate([m for _, m in settled])
        sizes = self.last[leaves] - self.first[leaves]
        at = ranges(self.first[leaves], sizes)
        cost = np.where(np.repeat(masks, sizes, axis=0), square - 2 * (self.points[at].astype(kind) @ c.T), far)
        return whole, (at, cost.argmin(axis=1))

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each centroid's count and sums."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, (at, owner) = self.filtered(centroids)
        for nodes, c in whole:
            np.add.at(n, c, self.last[nodes] - self.first[nodes])
            np.add.at(sums, c, self.sums[nodes])
        n += np.bincount(owner, minlength=len(n))
        for c in np.unique(owner):
            sums[c] += self.points[at[owner == c]].sum(axis=0, dtype=np.int64)
        return n, sums

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance."""
        got = np.zeros(len(self.points), np.int64)
        whole, (at, owner) = self.filtered(centroids)
        for nodes, c in whole:
            sizes = self.last[nodes] - self.first[nodes]
            got[ranges(self.first[nodes], sizes)] = np.repeat(c, sizes)
        got[at] = owner
        away = self.points.astype(np.int64) - centroids[got]
        return got, (away * away).sum(axis=1)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[i]``, ``first[i] + 1`` ... of ``sizes[i]`` numbers, for each i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def plant(vectors: DataFrame, id_column: str, vector_column: str, dims: int, scale: int) -> DataFrame:
    """A row a block of at most ``BLOCK`` vectors, with its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0

        def planted() -> pa.RecordBatch:
            row = Tree(np.concatenate(points)).row(ids)
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.bool_(), *[pa.binary()] * 6]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["ids", "points", "wide", "low", "high", "sums", "first", "last", "child"])

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                rows, x = integers(part.column(1), dims, scale)
                if n + len(rows) > BLOCK:
                    yield planted()
                    ids, points, n = [], [], 0
                ids += part.column(0).take(pa.array(rows)).to_pylist()
                points.append(x)
                n += len(rows)
        if n:
            yield planted()

    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("c0"), F.col(f"`{vector_column}`").alias("c1")).mapInArrow(run, TREE)


def first_centroids(vectors: DataFrame, k: int, seed: str, id_column: str, vector_column: str, dims: int, scale: int) -> np.ndarray:
    """The k vectors with the least sha256 of ``<seed>:<id>``, in that order."""
    v = F.col(f"`{vector_column}`")
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256).alias("h"), v.alias("v"))
    rows = hashed.where(F.col("h").isNotNull() & is_vector(F.col("v"), dims)).orderBy("h", "v").limit(k).toArrow()
    column = rows["v"].combine_chunks()
    return integers(column, dims, scale)[1].astype(np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", id_column: str = "vec_id", vector_column: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id (named as ``id_column``), cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed, id_column, vector_column, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_column}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = written(plant(vectors, id_column, vector_column, dims, scale), "trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    placed = written(labelled(trees, centroids), "placed")
    # k rows at most, each with its centroid's digest
    sums = {r.cluster: r for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(int(sum(r.s for r in sums.values())))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(c, fits(int(r.s)), total, digest[c]) for c, r in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    got = placed.join(F.broadcast(table), "cluster")
    return got.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' exact floored mean; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = Tree.read(batch.slice(i, 1).to_pylist()[0], dims).totals(centroids)
                n += a
                sums += b
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = trees.drop("ids").mapInArrow(run, "c int, n long, s array<long>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]).collect()
    out = centroids.copy()
    for r in rows:
        if r.n:
            out[r.c] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def labelled(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                owner, away = Tree.read({f: row.column(f)[0].as_py() for f in row.schema.names if f != "ids"}, dims).labels(centroids)
                yield pa.record_batch([row.column("ids").flatten(), pa.array(owner.astype(np.int32)), pa.array(away)], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")
