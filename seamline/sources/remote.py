"""A remote source read through a cache that all executors share.

``requests`` cuts sorted keys into batches; ``fetched`` writes the batches as one
file a reader and reads them through the data source ``cached_http``: each reader
goes through its file, one request at a time, ``delay`` seconds apart, so the whole
job asks at most ``readers / delay`` times a second however large the cluster.

An answer is stored under the sha256 of what was asked, first under a name of its
own, then renamed: a reader that dies leaves nothing that would be trusted, and two
that ask the same write the same. What is stored is never asked again, so a task
that is run anew, or a job resumed after a break, asks only for what is missing.
``offline`` asks nothing: batches that are not stored are left out.
"""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seamline.operators.scan import numbered
from seamline.session import opened, scratch, ship

SCHEMA = "request array<string>, body string, cached boolean"


def entry(kind: str, request: list[str]) -> str:
    """The name of a request's answer in the cache; no two lists of keys share one."""
    return f"{kind}_{hashlib.sha256(''.join(f'{len(k)}:{k}' for k in request).encode()).hexdigest()}.json"


class Cache:
    def __init__(self, uri: str, kind: str):
        (self.files, self.root), self.kind = opened(uri), kind
        self.files.create_dir(self.root, recursive=True)

    def get(self, request: list[str]) -> str | None:
        try:
            with self.files.open_input_file(f"{self.root}/{entry(self.kind, request)}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, request: list[str], body: str) -> None:
        own = f"{self.root}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(own) as f:
            f.write(body.encode())
        self.files.move(own, f"{self.root}/{entry(self.kind, request)}")


@dataclass
class Batches(InputPartition):
    path: str


class CachedHttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Batches]:
        files, path = opened(self.options["batches"])
        found = files.get_file_info(fs.FileSelector(path, recursive=False))
        return [Batches(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]

    def asked(self, request: list[str]) -> str:
        """One answer from the endpoint; errors that may pass are tried again, others end the task."""
        o = self.options
        data = urllib.parse.urlencode({o.get("parameter", "keys"): o.get("separator", "|").join(request)})
        call = urllib.request.Request(f"{o['endpoint']}?{data}", headers={"User-Agent": o["agent"]})
        tries = int(o.get("tries", 3))
        for n in range(tries):
            try:
                with urllib.request.urlopen(call, timeout=float(o.get("timeout", 60))) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as e:
                if n == tries - 1 or e.code < 500 and e.code != 429:
                    raise RuntimeError(f"{o['endpoint']} answered {e.code}: {e.read(200).decode(errors='replace')}") from e
            except urllib.error.URLError:
                if n == tries - 1:
                    raise
            time.sleep(float(o.get("delay", 1)) * 2**n)
        raise AssertionError

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        o = self.options
        files, _ = opened(o["batches"])
        cache, offline, delay, last = Cache(o["cache"], o.get("kind", "keys")), o.get("offline", "false").lower() == "true", float(o.get("delay", 1)), 0.0
        with files.open_input_file(partition.path) as f:
            for rows in pq.ParquetFile(f).iter_batches(batch_size=64, columns=["request"]):
                for request in rows.column(0).to_pylist():
                    body, had = cache.get(request), True
                    if body is None and not offline:
                        time.sleep(max(0.0, last + delay - time.monotonic()))
                        last, had = time.monotonic(), False
                        body = self.asked(request)
                        cache.put(request, body)
                    if body is not None:
                        yield pa.record_batch([pa.array([request], pa.list_(pa.string())), pa.array([body], pa.string()), pa.array([had])], names=["request", "body", "cached"])


class CachedHttp(DataSource):
    """Options: batches, cache, endpoint, agent; and kind, parameter, separator, delay, timeout, tries, offline."""

    @classmethod
    def name(cls) -> str:
        return "cached_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CachedHttpReader:
        needed = ["batches", "cache"] + ([] if self.options.get("offline", "false").lower() == "true" else ["endpoint", "agent"])
        if gone := [o for o in needed if not self.options.get(o)]:
            raise ValueError(f"options are missing: {gone}")
        return CachedHttpReader(self.options)


def requests(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(no, request): the distinct keys that are not null, in order, ``size`` a request."""
    rows = numbered(keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct(), "key", name="n")
    return rows.groupBy(F.expr(f"n div {size}").alias("no")).agg(F.array_sort(F.collect_list("key")).alias("request"))


def fetched(keys: DataFrame, key: str, cache: str, size: int = 50, readers: int = 2, **options: str) -> DataFrame:
    """(request, body, cached) for all keys; ``options`` are those of ``cached_http``."""
    spark = keys.sparkSession
    ship(spark)
    spark.dataSource.register(CachedHttp)
    path = scratch(spark, "batches")
    requests(keys, key, size).repartition(readers, "no").write.parquet(path)
    return spark.read.format("cached_http").options(batches=path, cache=cache, **options).load()


def stored(answers: DataFrame, cache: str, kind: str = "keys") -> int:
    """Puts (request, body) rows into a cache, each task its own; returns their number. So a dump of the source spares the requests."""
    ship(answers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, n = Cache(cache, kind), 0
        for batch in batches:
            for request, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to.put(request, body)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return answers.select("request", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def answers_by_key(got: DataFrame, entries: str = "map<string, string>") -> DataFrame:
    """(key, value) of bodies that are JSON objects by key; a key that was asked for and not answered has none."""
    body: Column = F.from_json("body", entries)
    return got.select("request", F.explode(body).alias("key", "value")).where(F.array_contains("request", F.col("key"))).select("key", "value")


def cached_count(spark: SparkSession, cache: str) -> int:
    files, root = opened(cache)
    return sum(f.base_name.endswith(".json") for f in files.get_file_info(fs.FileSelector(root, recursive=False)))
