import io
import random

import pytest

from seamline.llm import warc


@pytest.mark.parametrize("size", [70_000, 3_000_000])
def test_warc_with_a_long_url(spark, size):
    pages = spark.createDataFrame([(1, "data:" + "x" * size, "same"), (2, "u", "other"), (0, "v", "same")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(spark, pages, split_bytes=500).collect()}
    assert got == {0: "revisit", 1: "response", 2: "response"}


def test_warc_records_are_counted(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.with_refers_to(pages))
    with pytest.raises(ValueError):
        warc.checked(warc.read_archives(manifest).limit(1), manifest)


@pytest.mark.parametrize("before", range(5))
def test_warc_record_that_starts_at_the_edge_of_a_block(monkeypatch, before):
    rng = random.Random(3)
    first = warc.record(0, "u", rng.randbytes(3000), None)
    data = first + b"".join(warc.record(i, "u", rng.randbytes(rng.randint(0, 900)), None) for i in range(1, 40))
    monkeypatch.setattr(warc, "BLOCK", len(first) + before)
    chain = [r.headers["warc-record-id"] for r in warc.read_range(io.BytesIO(data), len(data), 0, len(data))]
    assert chain == [warc._id(i) for i in range(40)]
    # a range that starts inside the first record looks for the next one byte by byte
    monkeypatch.setattr(warc, "BLOCK", len(first) - 100 + before)
    scan = [r.headers["warc-record-id"] for r in warc.read_range(io.BytesIO(data), len(data), 100, len(data))]
    assert scan == chain[1:]
