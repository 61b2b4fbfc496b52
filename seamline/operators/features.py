"""Leak-free features: what was known before the match, the season or the ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import ball
from seamline.operators.rates import OUT, shrink, shrinkage_weight
from seamline.operators.windows import running_state

BEFORE = (W.unboundedPreceding, -1)


def head_to_head_before(x: DataFrame) -> DataFrame:
    """(batter, bowler, match_id, h_balls, h_runs, h_outs): sums over earlier matches of the pair, a match's own balls never included.

    Aggregated to the match first, so the window orders matches, not balls.
    """
    x = x.where(~F.col("super_over"))
    m = x.groupBy("batter", "bowler", "match_id").agg(F.count_if("legal").alias("balls"), F.sum(F.col("runs_bat").cast("bigint")).alias("runs"), F.count_if(F.expr("costs AND credited AND player_out = batter")).alias("outs"))
    w = W.partitionBy("batter", "bowler").orderBy("match_id").rowsBetween(*BEFORE)
    return m.select("batter", "bowler", "match_id", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"h_{c}") for c in ("balls", "runs", "outs")])


def season_rates_before(counts: DataFrame, kappa: float) -> DataFrame:
    """(season, cell, player, outcome, posterior, weight): fits on the seasons before each season.

    What a player had up to a season stands for each later season up to, and with, the
    next one in which they have data: sums run within a player, and nothing is joined
    with later seasons. Players absent from a season keep what they had.
    """
    seasons = counts.select("season").distinct().agg(F.array_sort(F.collect_set("season")).alias("every"))  # a row a season
    each = counts.groupBy("cell", "player", "outcome", "season").agg(F.sum("n").alias("n"))
    w = W.partitionBy("cell", "player", "outcome").orderBy("season")
    upto = each.select("cell", "player", "outcome", "season", F.sum("n").over(w).alias("n"), F.lead("season").over(w).alias("next")).crossJoin(F.broadcast(seasons))
    later = F.filter("every", lambda s: (s > F.col("season")) & (F.col("next").isNull() | (s <= F.col("next"))))
    own = upto.select(F.explode(later).alias("s"), "cell", "player", "outcome", "n")
    cell = own.groupBy("s", "cell", "outcome").agg(F.sum("n").alias("cn")).withColumn("prior", F.col("cn") / F.sum("cn").over(W.partitionBy("s", "cell")).cast("double"))
    who = own.groupBy("s", "cell", "player").agg(F.sum("n").alias("total"))
    full = who.join(F.broadcast(cell.select("s", "cell", "outcome", "prior")), ["s", "cell"]).join(own, ["s", "cell", "player", "outcome"], "left")
    k = F.lit(kappa)
    return full.select(F.col("s").alias("season"), "cell", "player", "outcome", shrink(F.coalesce("n", F.lit(0)), F.col("total"), F.col("prior"), k).alias("posterior"), shrinkage_weight(F.col("total"), k).alias("weight"))


def summaries_before(counts: DataFrame, kappa: float) -> DataFrame:
    """(season, cell, player) with expected runs, dot, boundary, wicket share and weight from the seasons before, for the seasons in which a player has data.

    Sums over earlier seasons are windows over a row a season, cell and player,
    so nothing is joined with later seasons; priors are a row a season and cell.
    """
    names, before = [f"n{k}" for k in OUT], lambda *keys: W.partitionBy(*keys).orderBy("season").rowsBetween(*BEFORE)
    own = counts.groupBy("season", "cell", "player").agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in OUT])
    cell = own.groupBy("season", "cell").agg(*[F.sum(n).alias(n) for n in names])
    cell = cell.select("season", "cell", *[F.coalesce(F.sum(n).over(before("cell")), F.lit(0)).alias(f"c{n}") for n in names])
    sums = own.select("season", "cell", "player", *[F.coalesce(F.sum(n).over(before("cell", "player")), F.lit(0)).alias(n) for n in names])
    total, of_cell, k = sum((F.col(n) for n in names), F.lit(0)), sum((F.col(f"c{n}") for n in names), F.lit(0)), F.lit(kappa)
    df = sums.withColumn("total", total).where("total > 0").join(F.broadcast(cell), ["season", "cell"])
    post = [shrink(F.col(n), F.col("total"), F.col(f"c{n}") / of_cell.cast("double"), k) for n in names]
    return df.select(
        "season", "cell", "player", sum((p * F.lit(float(r)) for p, r in zip(post, ball.NOMINAL_RUNS, strict=True)), F.lit(0.0)).alias("exp_runs"),
        post[0].alias("dot"), (post[4] + post[5]).alias("boundary"), post[6].alias("wicket"), shrinkage_weight(F.col("total"), k).alias("weight"),
    )


def venue_rate_before(x: DataFrame, least: int = 600) -> DataFrame:
    """(season, venue, venue_rate) from earlier seasons, for the seasons that a venue has; the overall rate for venues with few balls, 0 in the first season."""
    v = x.groupBy("season", "venue").agg(F.sum(F.col("total").cast("bigint")).alias("t"), F.count_if("legal").alias("l"))
    sums = lambda w, *names: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, n in zip(("t", "l"), names, strict=True)]
    # a row a season meets in one task, never more
    every = v.groupBy("season").agg(F.sum("t").alias("t"), F.sum("l").alias("l")).select("season", *sums(W.orderBy("season").rowsBetween(*BEFORE), "all_t", "all_l"))
    own = v.select("season", "venue", *sums(W.partitionBy("venue").orderBy("season").rowsBetween(*BEFORE), "t", "l")).join(F.broadcast(every), "season")
    rate = F.when(F.col("l") >= least, ball.ratio(F.col("t"), F.col("l"))).otherwise(ball.ratio(F.col("all_t"), F.col("all_l")))
    return own.select("season", "venue", rate.alias("venue_rate"))


FEATURES = [
    "innings", "over", "legal_ball", "balls_remaining", "score", "wickets", "crr", "target", "required_runs", "required_rate", "striker_balls", "new_batter", "stand_runs", "stand_balls", "is_powerplay", "is_death", "striker_lhb", "bowler_spin", "moves_away", "venue_rate", "h_balls", "h_strike_rate", "h_out_rate",
    "bat_exp_runs", "bat_dot", "bat_boundary", "bat_wicket", "bowl_exp_runs", "bowl_economy", "bowl_wicket",
]


def extract(x: DataFrame, bat_attr: DataFrame, bowl_attr: DataFrame, kappa: float = 150.0) -> DataFrame:
    """A row a delivery outside super overs whose striker's hand and bowler's class are known: thirty features, label and keys.

    The second innings of a match chases the first one's runs plus one.
    """
    s = running_state(x.where(~F.col("super_over")))
    totals = x.where(~F.col("super_over")).groupBy("match_id", "innings_id").agg(F.sum("total").alias("runs"))
    targets = totals.withColumn("target", F.lag("runs").over(W.partitionBy("match_id").orderBy("innings_id")) + 1).select("innings_id", F.coalesce("target", F.lit(0)).alias("target"))
    s = s.join(targets, "innings_id").join(bat_attr.withColumnRenamed("player", "batter"), "batter").join(bowl_attr.withColumnRenamed("player", "bowler"), "bowler").where("hand IS NOT NULL AND bowl_class IS NOT NULL")
    s = s.join(head_to_head_before(x), ["batter", "bowler", "match_id"], "left").join(venue_rate_before(x), ["season", "venue"], "left")
    from seamline.operators.rates import cell_counts

    sums = summaries_before(cell_counts(x, bat_attr, bowl_attr), kappa)
    p = ball.phase_no()
    s = s.withColumn("bat_cell", ball.cell(F.lit(1), p, ball.is_spin(F.col("bowl_class")).cast("int"))).withColumn("bowl_cell", ball.cell(F.lit(0), p, (F.col("hand") == "LHB").cast("int")))
    for side, who in (("bat", "batter"), ("bowl", "bowler")):
        mine = sums.select("season", F.col("cell").alias(f"{side}_cell"), F.col("player").alias(who), *[F.col(c).alias(f"{side}_{c}") for c in ("exp_runs", "dot", "boundary", "wicket", "weight")])
        s = s.join(mine, ["season", f"{side}_cell", who], "left")
    left = F.greatest(F.lit(0), F.lit(120) - F.col("legal_before"))
    chase = F.col("target") > 0
    need = F.when(chase, F.greatest(F.lit(0), F.col("target") - F.col("score_before"))).otherwise(0)
    flag = lambda c: c.cast("int")
    cols = {
        "innings": F.when(chase, 2).otherwise(1), "over": F.col("over"), "legal_ball": F.col("legal_ball"), "balls_remaining": left, "score": F.col("score_before"), "wickets": F.col("wickets_before"),
        "crr": ball.ratio(F.col("score_before"), F.col("legal_before"), 6), "target": F.col("target"), "required_runs": need, "required_rate": F.when(chase, ball.ratio(need, left, 6)).otherwise(0.0),
        "striker_balls": F.col("striker_balls"), "new_batter": flag(F.col("striker_balls") < 6), "stand_runs": F.col("stand_runs"), "stand_balls": F.col("stand_balls"), "is_powerplay": flag(F.col("over") < 6), "is_death": flag(F.col("over") >= 15),
        "striker_lhb": flag(F.col("hand") == "LHB"), "bowler_spin": flag(ball.is_spin(F.col("bowl_class"))), "moves_away": flag(ball.moves_away(F.col("bowl_class"), F.col("hand"))), "venue_rate": F.coalesce("venue_rate", F.lit(0.0)),
        "h_balls": F.coalesce("h_balls", F.lit(0)), "h_strike_rate": ball.ratio(F.coalesce("h_runs", F.lit(0)), F.coalesce("h_balls", F.lit(0)), 100), "h_out_rate": ball.ratio(F.coalesce("h_outs", F.lit(0)), F.coalesce("h_balls", F.lit(0))),
        "bat_exp_runs": F.coalesce("bat_exp_runs", F.lit(0.0)), "bat_dot": F.coalesce("bat_dot", F.lit(0.0)), "bat_boundary": F.coalesce("bat_boundary", F.lit(0.0)), "bat_wicket": F.coalesce("bat_wicket", F.lit(0.0)),
        "bowl_exp_runs": F.coalesce("bowl_exp_runs", F.lit(0.0)), "bowl_economy": 6 * F.coalesce("bowl_exp_runs", F.lit(0.0)), "bowl_wicket": F.coalesce("bowl_wicket", F.lit(0.0)),
    }
    return s.select("delivery_id", "match_id", "season", F.col("outcome").alias("label"), *[cols[c].cast("double").alias(c) for c in FEATURES])


def win_matrix(x: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Second innings with need and balls left: six features, label whether the chase came off, season."""
    s = running_state(x.where(~F.col("super_over")))
    totals = x.where(~F.col("super_over")).groupBy("match_id", "innings_id").agg(F.sum("total").alias("runs"))
    first = totals.withColumn("target", F.lag("runs").over(W.partitionBy("match_id").orderBy("innings_id")) + 1).where("target IS NOT NULL")
    s = s.join(first.select("innings_id", "target", F.col("runs").alias("final")), "innings_id")
    v = x if cutoff is None else x.where(F.col("season") <= cutoff)
    from seamline.operators.aggregate import venue_rates

    s = s.join(F.broadcast(venue_rates(v).select("venue", "run_rate")), "venue", "left")  # a row a venue
    need, left = F.col("target") - F.col("score_before"), F.lit(120) - F.col("legal_before")
    d = s.withColumn("need", need).withColumn("balls_left", left).where("need > 0 AND balls_left > 0")
    return d.select("delivery_id", "season", "need", "balls_left", (10 - F.col("wickets_before")).alias("wickets_left"), F.round(F.col("need") * 6.0 / F.col("balls_left"), 6).alias("required_rate"), F.round(ball.ratio(F.col("score_before"), F.col("legal_before"), 6), 6).alias("current_rate"), F.coalesce("run_rate", F.lit(0.0)).alias("venue_rate"), (F.col("final") >= F.col("target")).cast("int").alias("label"))


def season_split(df: DataFrame, holdout: int = 2) -> DataFrame:
    """Adds ``split``: train up to the last season less ``holdout``, else test."""
    cutoff = df.agg((F.max("season") - holdout).alias("cutoff"))
    return df.crossJoin(cutoff).withColumn("split", F.when(F.col("season") <= F.col("cutoff"), "train").otherwise("test")).drop("cutoff")
