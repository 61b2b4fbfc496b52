"""The cached source against a server on this machine that counts what it is asked."""

import http.server
import json
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.sources import remote


@pytest.fixture
def server():
    asked, agents, broken = Counter(), set(), {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            keys = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["keys"][0].split("|")
            agents.add(self.headers["User-Agent"])
            asked[tuple(keys)] += 1
            code = broken.get(keys[0], [200])
            code = code.pop(0) if len(code) > 1 else code[0]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({k: f"text of {k} é" for k in keys if not k.startswith("gone")} | {"other": "x"}).encode() if code == 200 else b"no")

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/api", asked, agents, broken
    s.shutdown()


def keys_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string").repartition(5)


def test_each_key_is_asked_for_once(spark, server, tmp_path):
    url, asked, agents, _ = server
    names = [f"k{i:03}" for i in range(95)] + ["gone1", "é ü", None, "k001"]
    how = {"endpoint": url, "agent": "tests (nobody@example.org)", "delay": "0.01", "size": 10, "readers": 3}
    cache = str(tmp_path / "cache")
    first = remote.fetched(keys_of(spark, names), "key", cache, **how)
    got = {r.key: r.value for r in remote.answers_by_key(first).collect()}
    distinct = {n for n in names if n}
    assert got == {n: f"text of {n} é" for n in distinct if n != "gone1"}
    assert agents == {how["agent"]} and set(asked.values()) == {1} and sorted(k for r in asked for k in r) == sorted(distinct)
    again = remote.fetched(keys_of(spark, reversed(names)), "key", f"file://{cache}", **how)
    assert again.where("NOT cached").count() == 0 and set(asked.values()) == {1}
    assert remote.cached_count(spark, cache) == len(asked) == 10
    assert again.rdd.getNumPartitions() == 3


def test_errors_pass_or_end_the_job_and_leave_nothing(spark, server, tmp_path):
    url, asked, _, broken = server
    how = {"endpoint": url, "agent": "a", "delay": "0.01", "size": 1, "readers": 1}
    broken["flaky"] = [503, 429, 200]
    broken["never"] = [404]
    assert remote.fetched(keys_of(spark, ["flaky"]), "key", str(tmp_path / "a"), **how).count() == 1 and asked["flaky",] == 3
    with pytest.raises(Exception, match="404"):
        remote.fetched(keys_of(spark, ["fine", "never"]), "key", str(tmp_path / "b"), **how).count()
    assert remote.cached_count(spark, str(tmp_path / "b")) == 1
    broken["never"] = [200]
    resumed = remote.fetched(keys_of(spark, ["fine", "never"]), "key", str(tmp_path / "b"), **how).collect()
    assert {r.request[0]: r.cached for r in resumed} == {"fine": True, "never": False} and asked["fine",] == 1


def test_offline_and_bounded_rate(spark, server, tmp_path):
    url, asked, _, _ = server
    cache = str(tmp_path / "c")
    known = keys_of(spark, ["a", "b"]).select(F.array("key").alias("request"), F.to_json(F.create_map("key", F.lit("v"))).alias("body"))
    assert remote.stored(known, cache) == 2
    got = remote.fetched(keys_of(spark, ["a", "b", "c"]), "key", cache, size=1, offline="true")
    assert {r.key for r in remote.answers_by_key(got).collect()} == {"a", "b"} and not asked
    import time

    t = time.monotonic()
    remote.fetched(keys_of(spark, [f"r{i}" for i in range(6)]), "key", cache, size=1, readers=1, endpoint=url, agent="a", delay="0.3").count()
    assert time.monotonic() - t > 1.4 and len(asked) == 6
    with pytest.raises(Exception, match="missing"):
        remote.fetched(keys_of(spark, ["a"]), "key", cache).count()
    assert remote.fetched(keys_of(spark, []), "key", cache, offline="true").count() == 0


def test_names_of_answers_do_not_collide():
    assert len({remote.entry("k", r) for r in (["a", "b"], ["ab"], ["a|b"], ["1:a"], ["b", "a"], [])}) == 6
