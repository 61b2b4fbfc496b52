"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.session import ship  # noqa: F401

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = 4 << 20  # texts, and pairs of sets, take kilobytes a row


def shared_dir(spark: SparkSession) -> str:
    """The URI in ``spark.checkpoint.dir``; where that is unset, a temporary folder for a local master (tests), and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, batch_bytes: int | None) -> Iterator[None]:
    """What runs inside sends Python batches of at most ``batch_bytes``, or of a row; None leaves them as they are."""
    if batch_bytes is None:
        yield
        return
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, f"{batch_bytes}b")
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs nothing.

    ``batch_bytes`` bounds the batches that tasks send to Python meanwhile.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with batches_of(spark, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front of those that are taken."""
    used = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def numbered(docs: DataFrame, keep: list[str], *more: Column) -> tuple[DataFrame, list[T.StructField]]:
    """Columns ``keep`` and ``more`` named c0, c1 and so on, as ``mapInArrow`` takes no name with a dot; and a field c0, c1 ... for each of ``keep``."""
    got = docs.select(*[c.alias(f"c{i}") for i, c in enumerate([*[F.col(f"`{k}`") for k in keep], *more])])
    return got, got.schema.fields[: len(keep)]
