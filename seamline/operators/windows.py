"""Operators over the order of deliveries, and ranked or dated lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.scan import in_order, numbered

BEFORE = (W.unboundedPreceding, -1)


def _before(c: str, *keys: str, order: str = "delivery_id") -> Column:
    """Sum of the earlier rows of a partition, 0 for the first."""
    return F.coalesce(F.sum(F.expr(c).cast("bigint")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE)), F.lit(0))


def running_state(x: DataFrame) -> DataFrame:
    """State before each ball: innings score, wickets, legal balls; legal balls in the over; the striker's and the stand's balls and runs."""
    legal, costs = "CASE WHEN legal THEN 1 ELSE 0 END", "CASE WHEN costs THEN 1 ELSE 0 END"
    x = x.withColumns({
        "score_before": _before("total", "innings_id"), "wickets_before": _before(costs, "innings_id"), "legal_before": _before(legal, "innings_id"),
        "legal_ball": _before(legal, "innings_id", "over"), "striker_balls": _before(legal, "innings_id", "batter"),
    })
    # the ball that costs a wicket belongs to the old stand
    return x.withColumns({"stand_runs": _before("total", "innings_id", "wickets_before"), "stand_balls": _before(legal, "innings_id", "wickets_before")})


def index_check(labelled: DataFrame, samples: int = 20) -> DataFrame:
    """Rows whose label "over.ball" (ball from 1) disagrees with over and legal_ball, unless ``miscounted``; at most ``samples`` of them, with the number of all."""
    over, nth = F.split_part("label", F.lit("."), F.lit(1)).cast("int"), F.split_part("label", F.lit("."), F.lit(2)).cast("int") - 1
    bad = labelled.where(((over != F.col("over")) | (nth != F.col("legal_ball"))) & ~F.col("miscounted"))
    return bad.orderBy("delivery_id").limit(samples).crossJoin(bad.agg(F.count("*").alias("mismatches")))  # one row


def batting_positions(x: DataFrame) -> DataFrame:
    """Mean place in the order of first appearance and number of innings; the striker is before the non-striker."""
    x = x.where(~F.col("super_over"))
    seen = x.select("innings_id", F.explode(F.array(F.struct(F.col("batter").alias("player"), (F.col("delivery_id") * 2).alias("at")), F.struct(F.col("non_striker").alias("player"), (F.col("delivery_id") * 2 + 1).alias("at")))).alias("r")).select("innings_id", "r.*").where("player IS NOT NULL")
    first = seen.groupBy("innings_id", "player").agg(F.min("at").alias("at"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("innings_id").orderBy("at", "player")))
    return placed.groupBy("player").agg(F.round(F.sum("place").cast("double") / F.count("*"), 6).alias("mean_position"), F.count("*").alias("innings"))


def batting_order(positions: DataFrame, least: int = 8, default: float = 6.0) -> DataFrame:
    key = F.when(F.col("innings") >= least, F.col("mean_position")).otherwise(F.lit(default))
    return numbered(positions.select("player", key.alias("key")), "key", "player").select("player", "key", (F.col("row") + 1).alias("place"))


def streak(results: DataFrame, player: str, upto: str) -> DataFrame:
    """Length of the run of consecutive dates that ends exactly at ``upto``; 0 if there is none. One row."""
    days = results.where((F.col("player") == player) & (F.col("date") <= upto)).select(F.to_date("date").alias("day")).distinct()
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(W.partitionBy().orderBy("day"))))
    n = island.groupBy("island").agg(F.max("day").alias("last"), F.count("*").alias("n")).where(F.col("last") == F.to_date(F.lit(upto)))
    return n.agg(F.coalesce(F.max("n"), F.lit(0)).alias("streak"))


def streaks(results: DataFrame, upto: str) -> DataFrame:
    """``streak`` of every player at once."""
    days = results.where((F.col("date") <= upto) & (F.trim("player") != "")).select("player", F.to_date("date").alias("day")).distinct()
    island = days.withColumn("island", F.date_sub("day", F.row_number().over(W.partitionBy("player").orderBy("day"))))
    n = island.groupBy("player", "island").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    return n.groupBy("player").agg(F.max(F.when(F.col("last") == F.to_date(F.lit(upto)), F.col("n")).otherwise(0)).alias("streak"))


def placed_innings(x: DataFrame) -> DataFrame:
    """(innings_id, lo, hi, n, gap, fault): first and last delivery of every innings, its deliveries, and the ids between it and the innings before (null for the first)."""
    runs = x.groupBy("innings_id").agg(F.min("delivery_id").alias("lo"), F.max("delivery_id").alias("hi"), F.count("*").alias("n"))
    placed = in_order(runs, "lo", "innings_id", lags=("hi",))
    return placed.select("innings_id", "lo", "hi", "n", (F.col("lo") - F.col("last_hi") - 1).alias("gap")).withColumn("fault", F.expr("coalesce(gap, 0) != 0 OR hi - lo + 1 != n"))


def contiguity(x: DataFrame) -> DataFrame:
    """Innings whose deliveries do not lie together in delivery order: none in a sound table."""
    return placed_innings(x).where("fault").drop("fault")


def over_deltas(x: DataFrame, value: Column) -> DataFrame:
    """Change of a value from each over's first ball to the next over's, within innings; they telescope."""
    overs = x.groupBy("innings_id", "over").agg(F.min_by(value, "delivery_id").alias("before"))
    return overs.withColumn("delta", F.lead("before").over(W.partitionBy("innings_id").orderBy("over")) - F.col("before"))


def terciles(pool: DataFrame, key: str) -> DataFrame:
    """Tiers 0, 1, 2 of a ranked pool: the first two have a third of it, rounded down, each."""
    size = pool.agg(F.floor(F.count("*") / 3).alias("third"))
    r = numbered(pool, key, "player", name="r").crossJoin(F.broadcast(size))  # one row
    return r.withColumn("tier", F.when(F.col("r") < F.col("third"), 0).when(F.col("r") < 2 * F.col("third"), 1).otherwise(2)).drop("r", "third")


def even_sample(pool: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows spread over the sorted pool: those at i * (size - 1) div (n - 1)."""
    r = numbered(pool, key, "player", name="r")
    size = pool.agg(F.count("*").alias("size"))
    at = pool.sparkSession.range(n).crossJoin(size).selectExpr("cast(id * (size - 1) div {} as bigint) AS at".format(max(1, n - 1))).distinct()
    return r.join(F.broadcast(at), F.col("r") == F.col("at"), "left_semi").drop("r")  # n rows


def per_group_then_fill(pool: DataFrame, group: str, key: str, n: int, each: int = 2) -> DataFrame:
    """``n`` rows: ``each`` of every group first, then the best of the rest."""
    r = pool.withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(key, "player")))
    return r.orderBy(F.when(F.col("_g") <= each, 0).otherwise(1), key, "player").limit(n).drop("_g")
