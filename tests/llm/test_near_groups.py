"""Near-duplicate groups larger than a block, and rows whose doc_id is missing or repeated."""

import random

import numpy as np

from seamline.llm import near_dup
from tests.llm.test_operators import brute_components, prose


def group(rng, n, most):
    base = prose(rng, 80).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_a_group_of_many_blocks(spark):
    rng = random.Random(21)
    texts = group(rng, 1300, 4) + group(rng, 40, 3) + [prose(rng, 50) for _ in range(40)]
    rng.shuffle(texts)
    assert near_dup.BLOCK < 1300
    sets, want = brute_components(texts, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, 85).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_edges_grow_in_proportion(spark, monkeypatch):
    rows = {}
    real = near_dup.connected

    def counted(links):
        rows[n] = rows.get(n, 0) + links.count()
        return real(links)

    monkeypatch.setattr(near_dup, "connected", counted)
    for n in (300, 1200):
        texts = group(random.Random(22), n, 4)
        near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80).count()
    assert all(rows[n] <= 4 * n for n in rows)  # four calls, a row a node at most


def test_missing_and_repeated_ids(spark):
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " end"), (None, a), (None, c), (None, c + " end"), (3, d), (3, d), (None, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and (2, 1, False) in got and (None, 1, False) in got and got.count((None, None, True)) == 3
    left = [(r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (1, b), next(x for x in left if x[1] in (c, c + " end")), (3, d), (None, ""), (4, None)], key=str)


def test_common_counts_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(9)]
    for rows, others in ((4, sets[4:]), (9, sets)):
        got = near_dup.common(sets, rows, columns=64)
        want = np.array([[len(np.intersect1d(x, y)) for y in others] for x in sets[:rows]])
        apart = ~np.eye(9, dtype=bool) if rows == 9 else np.ones(want.shape, bool)
        assert (got == want)[apart].all()
