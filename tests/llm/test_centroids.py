"""Filtered k-means against plain Python over every vector and centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from seamline.llm import centroids as ct


def brute(rows, k, rounds, dims):
    bound = ct.limit(dims)
    clip = lambda x: max(-bound, min(bound, math.floor(64 * x) if abs(x) < 1e300 else int(math.copysign(bound, x))))
    kept = [(i, tuple(clip(x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), n) for n, z in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [tuple(sum(x) // len(o) for x in zip(*o, strict=True)) if o else z for o, z in zip(own, c, strict=True)]
    out = [(i, near(v)) for i, v in kept]
    sums = [sum(d for _, (d, n) in out if n == j) for j in range(len(c))]
    return sorted(((i, n, d, sums[n], sum(sums), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, (d, n) in out), key=str)


def vectors(rng, n, dims, spread):
    hubs = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [[h + rng.gauss(0, 0.3) for h in rng.choice(hubs)] for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, "x", b"y") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double, id string, points binary")


def results(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("dims", "spread"), [(2, 3.0), (64, 0.2), (3, 5e5)])
def test_rounds_against_brute_force(spark, dims, spread):
    rng = random.Random(dims)
    rows = list(enumerate(vectors(rng, 400, dims, spread)))
    rows += [(1000 + i, list(rows[7][1])) for i in range(200)]  # a third of all are copies
    rows += [(3, list(rows[3][1])), (None, list(rows[9][1])), (None, [0.0] * dims)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dims + 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [math.nan] * dims), (2005, [math.inf] + [0.0] * (dims - 1))]
    rows += [(2006 + i, [float(rng.randint(-1, 1)) / 64 for _ in range(dims)]) for i in range(60)]  # ties
    got = results(ct.cluster(table(spark, rows), k=8, rounds=3, dims=dims))
    assert got == brute(rows, 8, 3, dims)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(vectors(rng, 300, 4, 2.0)))
    df = table(spark, rows)
    monkeypatch.setattr(ct, "BLOCK", 64)
    assert ct.plant(df, "vec_id", "embedding", 4, 64).count() >= 5
    assert results(ct.cluster(df, k=6, rounds=4, dims=4)) == brute(rows, 6, 4, 4)


def test_huge_components_fewer_vectors_and_empty_tables(spark):
    rows = [(1, [1e308, -1e308]), (2, [0.0, 1e30]), (3, [0.5, -0.5])]
    assert results(ct.cluster(table(spark, rows), k=16, rounds=2, dims=2)) == brute(rows, 16, 2, 2)
    assert ct.cluster(table(spark, rows).limit(0), dims=2).collect() == []
    assert ct.cluster(table(spark, [(1, [None, 1.0]), (2, None)]), dims=2).collect() == []
    alone = ct.cluster(table(spark, [(None, [1.0, 2.0])]), dims=2)
    assert alone.collect() == [] and alone.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nodes_are_pruned_and_assigned_whole():
    rng = np.random.default_rng(1)
    hubs = rng.integers(-4000, 4000, (8, 3))
    x = (hubs[rng.integers(0, 8, 4000)] + rng.integers(-20, 21, (4000, 3))).astype(np.int32)
    tree = ct.Tree(x)
    whole, (at, _) = tree.filtered(hubs.astype(np.int64))
    counted = sum(int((tree.last[n] - tree.first[n]).sum()) for n, _ in whole)
    assert counted + len(at) == 4000 and len(at) < 400
    want = ((x[:, None].astype(np.int64) - hubs) ** 2).sum(axis=2).argmin(axis=1)
    n, sums = tree.totals(hubs.astype(np.int64))
    assert (n == np.bincount(want, minlength=8)).all() and all((sums[c] == x[want == c].sum(axis=0)).all() for c in range(8))
    assert (tree.labels(hubs.astype(np.int64))[0] == want[tree.order]).all()
