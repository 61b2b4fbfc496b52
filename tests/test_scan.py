"""Global row numbers, running sums and previous values against plain Python, over many ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from seamline.operators import windows as wi
from seamline.operators.scan import in_order, numbered


@pytest.fixture
def many(spark):
    """Over a hundred partitions, none put together again."""
    names = {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([None, rng.randint(-5, 9)]), rng.choice([None, rng.random()]), rng.choice([None, "x", "yy"])) for i in range(n)]
    return rows + [(7, 10**6 + i, 1, 0.5, "hot") for i in range(n // 2)]  # a third have one key


def check(spark, rows, order, key):
    df = spark.createDataFrame(rows, "k int, i long, v long, f double, s string").repartition(7)
    got = sorted(in_order(df, *order, sums=("v", "f"), lags=("s", "v")).collect(), key=lambda r: r.row)
    want = sorted(rows, key=key)
    assert [r.i for r in got] == [r[1] for r in want] and [r.row for r in got] == list(range(len(rows)))
    v, f, last = 0, 0.0, (None, None)
    for g, w in zip(got, want, strict=True):
        assert g.before_v == v and g.before_f == pytest.approx(f) and (g.last_s, g.last_v) == last
        v, f, last = v + (w[2] or 0), f + (w[3] or 0), (w[4], w[2])


def nulls_first(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_over_a_hundred_ranges(spark, many):
    check(spark, rows_of(900, 1), ["k", "i"], nulls_first)


def test_few_ranges_and_falling_order(spark):
    check(spark, rows_of(60, 2), [F.desc("i")], lambda r: -r[1])
    check(spark, rows_of(1, 3), ["k", "i"], nulls_first)


def test_empty_and_small_batches(spark):
    empty = spark.createDataFrame([], "k int, v long")
    assert in_order(empty, "k", sums=("v",), lags=("v",)).collect() == [] and in_order(empty, "k", sums=("v",)).columns == ["k", "v", "row", "before_v"]
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark, rows_of(90, 4), ["k", "i"], nulls_first)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_plans_have_no_window_over_everything(spark, many, capsys):
    x = spark.createDataFrame([(i, i // 5, "p%d" % (i % 7), 1.0 * i) for i in range(500)], "delivery_id long, innings_id long, player string, key double")
    for df in (wi.contiguity(x), wi.terciles(x, "key"), wi.even_sample(x, "key", 5), numbered(x, "delivery_id")):
        df.explain()
        assert "Window" not in capsys.readouterr().out
    assert wi.contiguity(x).count() == 0
    gap = x.where("delivery_id NOT IN (250, 303)")  # the first and the middle one of an innings
    assert sorted((r.innings_id, r.gap) for r in wi.contiguity(gap).collect()) == [(50, 1), (60, 0)]


def test_every_innings_is_reported_with_its_place(spark):
    x = spark.createDataFrame([(i, i // 5) for i in range(50) if i not in (25, 33)], "delivery_id long, innings_id long")
    got = {r.innings_id: tuple(r)[1:] for r in wi.placed_innings(x).collect()}
    assert sorted(got) == list(range(10))
    assert got[0] == (0, 4, 5, None, False)
    assert got[5] == (26, 29, 4, 1, True)
    assert got[6] == (30, 34, 4, 0, True)
    assert got[7] == (35, 39, 5, 0, False)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_contiguity_query_has_a_row_an_innings(spark):
    from seamline.plans.registry import QUERIES, ex

    d = "/root/testdata/sf0.001"
    got = QUERIES["W9_contiguity"][0](spark, d)
    assert {"innings_id", "lo", "hi", "n", "gap"} <= set(got.columns)
    assert got.count() == ex(spark, d).select("innings_id").distinct().count() > 1
