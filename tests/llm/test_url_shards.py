"""Cascades by shard: each task holds its own, none is broadcast."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seamline.llm import url_filter
from seamline.llm.registry import LISTED_LABELS, URL_RULES


def hosts(n):
    rng = random.Random(5)
    return [None, "", "x", "http://" + "h" * 9000 + ".net/" + "p" * 9000] + [f"http://{rng.choice(['spam-farm.', 'a.', ''])}h{rng.randrange(n)}.net/{i}" for i in range(2 * n)] + ["http://hot.net/same"] * n


def test_shards_equal_one_cascade_without_a_broadcast(spark, monkeypatch):
    rows = [(i if i % 50 else None, u) for i, u in enumerate(hosts(400))]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("slice", F.lit(2))
    order = lambda df: sorted(map(str, df.collect()))
    want = order(url_filter.filter_urls(pages, URL_RULES, LISTED_LABELS, shards=1))
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *x: sent.append(x))
    monkeypatch.setattr(url_filter, "SLICE_ROWS", 100)  # several slices a shard
    assert order(url_filter.filter_urls(pages, URL_RULES, LISTED_LABELS, shards=4)) == want
    assert order(url_filter.filter_urls(pages, URL_RULES, [], shards=4)) == order(url_filter.filter_urls(pages, URL_RULES, [], shards=1))
    assert url_filter.filter_urls(pages.limit(0), URL_RULES, LISTED_LABELS, shards=4).count() == 0
    assert not sent


def test_a_task_forgets_a_cascade_when_the_next_begins(monkeypatch):
    class Counted(url_filter.Level):
        alive = most = 0

        def __init__(self, *args):
            super().__init__(*args)
            Counted.alive += 1
            Counted.most = max(Counted.most, Counted.alive)

        def __del__(self):
            Counted.alive -= 1

    monkeypatch.setattr(url_filter, "Level", Counted)
    shapes = {0: {s: (64, 1) for s in range(5)}}
    full = np.full(5, -1)  # the words of even shards let all through, those of odd shards nothing
    full[1::2] = 0
    batches = []
    for s in range(5):
        for is_row in (0, 1):
            ints = lambda x: pa.array([int(x)], pa.int32())
            longs = lambda x: pa.array([int(x)], pa.int64())
            batches.append(pa.record_batch([ints(s), ints(0), ints(is_row), ints(0), longs(0), longs(full[s]), pa.array([str(s)]), longs(7), longs(9)], names=list("abcdefghi")))
    got = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in url_filter.judged(iter(batches), shapes)]
    assert got == [("0", 1), ("1", 0), ("2", 1), ("3", 0), ("4", 1)]
    assert Counted.most == 1
