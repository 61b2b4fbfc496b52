"""Row numbers, running sums and previous values in one order over a whole table, without one task that sees it all.

Rows are range-partitioned by the order and sorted within the ranges; each task
numbers and sums its own rows as they stream by. The result is written, so that the
ranges stay as they are; a row a range (its count, sums and last values) goes to the
driver, which adds them up, and comes back to every row as a broadcast offset. So a
row is shuffled once, and no task holds more than a range. Rows that tie in the whole
order lie in one range and follow each other in any order: an order should be total.
A null value adds nothing to a sum. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.session import ship, written

LOCAL_BITS = 33  # of monotonically_increasing_id that number the rows of a partition


def in_order(df: DataFrame, *order: str | Column, sums: tuple[str, ...] = (), lags: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``row`` from 0; ``before_<c>``, the sum of ``c`` (long or double) over earlier rows; ``last_<c>``, ``c`` of the row before (null for the first)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    if sums or lags:
        ship(df.sparkSession)
        ranged = _streamed(ranged, sums, lags)
    saved = written(ranged.withColumn("_part", F.shiftright("_at", LOCAL_BITS)), "ordered")
    ends = [F.max_by(F.col(f"before_{c}") + F.coalesce(F.col(c), F.lit(0)), "_at").alias(f"s_{c}") for c in sums] + [F.max_by(F.struct(c), "_at").alias(f"l_{c}") for c in lags]
    # a row a range
    parts = sorted(saved.groupBy("_part").agg(F.count("*").alias("_n"), *ends).collect(), key=lambda r: r["_part"])
    rows, n, so_far, last = [], 0, dict.fromkeys(sums, 0), dict.fromkeys(lags)
    for p in parts:
        rows.append((p["_part"], n, *so_far.values(), *last.values()))
        n += p["_n"]
        so_far = {c: so_far[c] + p[f"s_{c}"] for c in sums}
        last = {c: p[f"l_{c}"][0] for c in lags}
    kind = {f.name: f.dataType for f in saved.schema}
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_first", T.LongType()), *[T.StructField(f"_s_{c}", kind[f"before_{c}"]) for c in sums], *[T.StructField(f"_l_{c}", kind[c]) for c in lags]])
    offsets = F.broadcast(df.sparkSession.createDataFrame([tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for v, f in zip(r, schema, strict=True)) for r in rows], schema))
    local = F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1)
    out = saved.join(offsets, "_part").withColumn("row", F.col("_first") + local)
    out = out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_s_{c}") for c in sums})
    out = out.withColumns({f"last_{c}": F.when(local == 0, F.col(f"_l_{c}")).otherwise(F.col(f"last_{c}")) for c in lags})
    return out.select(*df.columns, "row", *[f"before_{c}" for c in sums], *[f"last_{c}" for c in lags])


def _streamed(ranged: DataFrame, sums: tuple[str, ...], lags: tuple[str, ...]) -> DataFrame:
    """Sums over earlier rows and previous values within a range."""
    of = ranged.schema
    kinds = [np.float64 if isinstance(of[c].dataType, (T.DoubleType, T.FloatType)) else np.int64 for c in sums]
    more = [T.StructField(f"before_{c}", T.DoubleType() if k is np.float64 else T.LongType()) for c, k in zip(sums, kinds, strict=True)] + [T.StructField(f"last_{c}", of[c].dataType) for c in lags]
    schema = T.StructType([*of.fields, *more])
    sum_at, lag_at = [of.names.index(c) for c in sums], [of.names.index(c) for c in lags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, carried = [k(0) for k in kinds], [None] * len(lag_at)
        for batch in batches:
            n, out = batch.num_rows, []
            if not n:
                continue
            for i, (k, at) in enumerate(zip(kinds, sum_at, strict=True)):
                v = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(k)
                upto = so_far[i] + np.cumsum(v, dtype=k)
                out.append(pa.array(np.append(so_far[i], upto[:-1])))
                so_far[i] = upto[-1]
            for i, at in enumerate(lag_at):
                column = batch.column(at)
                first = pa.nulls(1, column.type) if carried[i] is None else carried[i]
                out.append(pa.concat_arrays([first, column.slice(0, n - 1)]))
                carried[i] = column.slice(n - 1)
            yield pa.record_batch([*batch.columns, *out], names=schema.names)

    return ranged.mapInArrow(run, schema)


def numbered(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """Adds ``name``, the row's number from 0 in the order."""
    got = in_order(df, *order)
    return got.withColumnRenamed("row", name)
