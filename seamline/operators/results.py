"""The results table: day figures, percentiles, leaderboards, inserts and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day_stats(runs: DataFrame, date: str) -> DataFrame:
    """Runs and average shares of a day; zeros for a day without runs."""
    d = runs.where(F.col("date") == date)
    share = lambda c, n: F.round(F.coalesce(F.avg(F.expr(c).cast("double")), F.lit(0.0)), 6).alias(n)
    return d.agg(F.count("*").alias("runs"), share("defended", "defended"), share("chased", "chased"), share("CASE WHEN defended = 1 AND chased = 1 THEN 1 ELSE 0 END", "both"), share("CASE WHEN defended = 0 AND chased = 0 THEN 1 ELSE 0 END", "neither"), share("total_score", "mean_score"))


def percentile(runs: DataFrame, date: str, score: float) -> DataFrame:
    """Percentage of the day's runs that scored strictly less; 0 without runs."""
    return runs.where(F.col("date") == date).agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("total_score") < score) * 100.0, F.count("*").cast("double")), F.lit(0.0)), 6).alias("percentile"))


def daily_leaderboard(runs: DataFrame, date: str, limit: int) -> DataFrame:
    """Named players of a day, solved runs first, then by score and id."""
    solved = (F.col("defended") == 1) & (F.col("chased") == 1)
    return runs.where((F.col("date") == date) & (F.trim("player") != "")).select("id", "player", solved.alias("solved"), "total_score").orderBy(F.desc("solved"), F.desc("total_score"), "id").limit(limit)


def insert_runs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` with those of ``new`` that break no rule: a new id, and one run a date and named player, the earliest; unnamed runs never clash."""
    named = F.trim("player") != ""
    one = new.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("finished_at"))).where("_r = 1").drop("_r").join(existing.select("id"), "id", "left_anti")
    key = [F.col("date"), F.when(named, F.col("player")).otherwise(F.concat(F.lit("\0"), F.col("id")))]
    first = one.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("finished_at", "id"))).where("_r = 1").drop("_r")
    taken = existing.where(named).select("date", "player").distinct()
    return existing.unionByName(first.where(named).join(taken, ["date", "player"], "left_anti").unionByName(first.where(~named)))


def set_player(runs: DataFrame, run_id: str, player: str) -> DataFrame:
    """``runs`` with the player of one run replaced; an unknown id is a ``KeyError``."""
    if runs.where(F.col("id") == run_id).isEmpty():
        raise KeyError(run_id)
    return runs.withColumn("player", F.when(F.col("id") == run_id, F.lit(player)).otherwise(F.col("player")))


def compare_reports(baseline: DataFrame, report: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The quality gate over (key, kind, value): every regression with its message.

    kind ``coverage`` may fall by ``tolerance``, ``count`` may not fall,
    ``fault`` may not rise; a key that the report lacks is a regression.
    """
    j = baseline.alias("b").join(report.alias("r"), ["key", "kind"], "full_outer").select("key", "kind", F.col("b.value").alias("was"), F.col("r.value").alias("now"))
    bad = F.when(F.col("was").isNull(), None).when(F.col("now").isNull(), "missing").when((F.col("kind") == "coverage") & (F.col("now") < F.col("was") - tolerance), "coverage fell").when((F.col("kind") == "count") & (F.col("now") < F.col("was")), "fewer").when((F.col("kind") == "fault") & (F.col("now") > F.col("was")), "more faults")
    return j.withColumn("regression", bad).where("regression IS NOT NULL")


def squad_check(submitted: DataFrame, pool: DataFrame, want: int, budget: int) -> DataFrame:
    """The first rule that a squad of ids breaks, null if none: count, membership, repetition, budget. One row."""
    j = submitted.join(pool.select("player", "cost"), "player", "left")
    g = j.agg(F.count("*").alias("n"), F.count_if(F.col("cost").isNull()).alias("outside"), F.count_distinct("player").alias("distinct"), F.coalesce(F.sum("cost"), F.lit(0)).alias("total"))
    return g.select(F.when(F.col("n") != want, "wrong number").when(F.col("outside") > 0, "not in the pool").when(F.col("distinct") < F.col("n"), "picked twice").when(F.col("total") > budget, "over budget").alias("broken"), "n", "total")


def draw(pool: DataFrame, key: str, n: int, avoid: DataFrame | None = None) -> DataFrame:
    """``n`` distinct rows of a pool in an order that only ``key`` and ids decide."""
    if avoid is not None:
        pool = pool.join(avoid.select("player"), "player", "left_anti")
    return pool.withColumn("at", F.sha2(F.concat(F.lit(key + "|"), F.col("player").cast("string")), 256)).orderBy("at", "player").limit(n).drop("at")


def card_status(position: Column, out: Column, next_in: Column) -> Column:
    """out, in or yet to bat."""
    return F.when(out, "out").when(position < next_in, "in").otherwise("yet")


def merged_attributes(manual: DataFrame, sourced: DataFrame) -> DataFrame:
    """(player, value, provenance): the manual value where there is one."""
    j = manual.alias("m").join(sourced.alias("s"), "player", "full_outer")
    return j.select("player", F.coalesce("m.value", "s.value").alias("value"), F.when(F.col("m.value").isNotNull(), "manual").when(F.col("s.value").isNotNull(), "sourced").alias("provenance"))
