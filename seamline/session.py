"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Settings every session should have.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "seamline", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that their Python finds it wherever it is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_seamline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "seamline_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("seamline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._seamline_shipped = True


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh path in the folder that executors share; a temporary one only for a local master without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or local path), and the path there."""
    return fs.FileSystem.from_uri(uri) if uri.split("/")[0].endswith(":") else (fs.LocalFileSystem(), uri)
