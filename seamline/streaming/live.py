"""The running state of innings over a stream of balls.

Balls are folded into keyed state in event order: a ball whose number was seen
is a repeat and changes nothing. State of an innings that stays silent for six
hours is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENCE_MS = 6 * 3600 * 1000
OUT = "innings_id long, delivery_id long, score_before long, wickets_before long, legal_before long"


def running_state_stream(balls: DataFrame, silence_ms: int | None = SILENCE_MS) -> DataFrame:
    """(innings_id, delivery_id, score_before, wickets_before, legal_before) of classified balls; ordered within each trigger, repeats dropped.

    ``silence_ms`` None keeps state for ever; a query with a time-out never ends by itself.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, score, wickets, legal = state.get if state.exists else (-1, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("delivery_id", kind="stable")
        out = []
        for d, total, costs, ok in zip(rows["delivery_id"], rows["total"], rows["costs"], rows["legal"], strict=True):
            if d <= last:
                continue
            out.append((key[0], d, score, wickets, legal))
            last, score, wickets, legal = int(d), score + int(total), wickets + int(costs), legal + int(ok)
        state.update((last, score, wickets, legal))
        if silence_ms is not None:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["innings_id", "delivery_id", "score_before", "wickets_before", "legal_before"])

    return balls.select("innings_id", "delivery_id", "total", "costs", "legal").groupBy("innings_id").applyInPandasWithState(fold, OUT, "last long, score long, wickets long, legal long", "append", GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed_runs(balls: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Runs and wickets by event-time window; balls that repeat within the watermark count once."""
    d = balls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery_id"])
    return d.groupBy(F.window("ts", width)).agg(F.sum(F.col("total").cast("bigint")).alias("runs"), F.count_if("costs").alias("wickets"))
