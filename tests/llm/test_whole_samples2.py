import os
import resource
import subprocess
import sys

from pyspark.sql import functions as F

from seamline.llm import url_filter, warc
from seamline.llm.registry import LISTED_LABELS, URL_RULES


def test_many_tiny_texts_take_little_memory():
    code = """
import resource, numpy as np, pyarrow as pa
from seamline.llm import lang_id, textkit as tk
batch = pa.record_batch([pa.array(["twenty bytes of text."] * 10_000)], names=["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for lo, hi, raw, off in tk.column_chunks(batch, "text", rows=lang_id.ROWS):
    lang_id.features(raw, off)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(got.stdout) < 150 and resource


def test_shards_follow_the_size(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.when(F.col("id") % 3 == 0, ".spam-farm.x/").otherwise(".y/")).alias("url"))
    one = url_filter.filter_urls(pages, URL_RULES, LISTED_LABELS).orderBy("page_id").collect()
    assert one == url_filter.filter_urls(pages, URL_RULES, LISTED_LABELS, max_bytes=1 << 10).orderBy("page_id").collect()
    assert sum(r.listed for r in one) == 1000


def test_a_payload_of_most_pages_is_sent_to_all(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 5)
    rows = [(i, f"http://a/{i}", "same" if i % 3 else ("pair" if i < 4 else f"own {i}")) for i in range(60)] + [(None, "u", "same")]
    got = {r.page_id: r.refers_to for r in warc.with_refers_to(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        best = max((j for j, _, h in rows if h == html and j is not None), default=None)
        assert got[i] == (best if i is not None and best != i else None)
