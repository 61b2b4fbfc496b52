"""Empirical-Bayes rates of twelve cells (role, phase, opposition) over nine outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import ball
from seamline.operators.aggregate import meet
from seamline.session import written

OUT = list(range(9))
KAPPA_RANGE = (1.0, 1e6)


def cell_counts(x: DataFrame, bat_attr: DataFrame, bowl_attr: DataFrame, parts: int | None = None) -> DataFrame:
    """(cell, player, season, outcome, n, runs): a ball counts for its bowler if the striker's hand is known, and for its batter if the bowler's class is.

    Role 0 is the bowler against right or left hand, role 1 the batter against pace or spin. With ``parts``, balls meet attributes, and are counted, in so many tasks.
    """
    long = _sides(x, bat_attr, bowl_attr, parts).select("c.cell", "c.player", "season", "outcome", "total")
    if parts:
        long = long.repartition(parts, "cell", "player")
    return long.groupBy("cell", "player", "season", "outcome").agg(F.count("*").alias("n"), F.sum(F.col("total").cast("bigint")).alias("runs")).where("player IS NOT NULL")


def _sides(x: DataFrame, bat_attr: DataFrame, bowl_attr: DataFrame, parts: int | None = None) -> DataFrame:
    """(season, outcome, total, c): a row a ball and side that it counts for. With ``parts``, joins are dealt to so many tasks (``meet``)."""
    p = ball.phase_no()
    x = x.where(~F.col("super_over"))
    if parts:  # no more than what counts goes through the joins
        x = x.select("season", "outcome", "total", "over", "batter", "bowler")
    for attr, key in ((bat_attr, "batter"), (bowl_attr, "bowler")):
        x = meet(x, attr.withColumnRenamed("player", key), key, "left", parts)
    bowl = F.when(F.col("hand").isNotNull(), F.struct(ball.cell(F.lit(0), p, (F.col("hand") == "LHB").cast("int")).alias("cell"), F.col("bowler").alias("player")))
    bat = F.when(F.col("bowl_class").isNotNull(), F.struct(ball.cell(F.lit(1), p, ball.is_spin(F.col("bowl_class")).cast("int")).alias("cell"), F.col("batter").alias("player")))
    return x.select("season", "outcome", "total", F.explode(F.array_compact(F.array(bowl, bat))).alias("c"))


def player_counts(x: DataFrame, bat_attr: DataFrame, bowl_attr: DataFrame, parts: int | None = None) -> DataFrame:
    """(cell, player, total, n, runs): ``by_player`` of all seasons with runs by outcome, from one scan and one shuffle; written, it serves priors and rates alike.

    With ``parts``, balls are dealt to so many tasks by player, and a task counts only its own players: partial counts of eighteen outcomes, nearly one a ball where balls lie by innings, would be much larger than the balls.
    """
    n = [F.count_if(F.col("outcome") == k) for k in OUT]
    runs = [F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("total").cast("bigint"))), F.lit(0)) for k in OUT]
    balls = _sides(x, bat_attr, bowl_attr, parts).select("c.cell", "c.player", "outcome", "total")
    if parts:
        balls = balls.repartition(parts, "cell", "player")
    return balls.groupBy("cell", "player").agg(F.count("*").alias("total"), F.array(*n).alias("n"), F.array(*runs).alias("runs")).where("player IS NOT NULL")


def nominal(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(zip(OUT, map(float, ball.NOMINAL_RUNS), strict=True)), "outcome int, nominal double"))


def cell_stats(counts: DataFrame, who: DataFrame | None = None) -> DataFrame:
    """(cell, outcome, n, players, prior, mean_runs) for every cell and outcome; a uniform prior and nominal runs where a cell is empty. ``who``: (cell, players, deliveries) if known."""
    spark = counts.sparkSession
    grid = spark.range(12).selectExpr("cast(id as int) AS cell").crossJoin(nominal(spark))
    n = counts.groupBy("cell", "outcome").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    if who is None:
        who = counts.groupBy("cell").agg(F.count_distinct("player").alias("players"), F.sum("n").alias("deliveries"))
    g = grid.join(n, ["cell", "outcome"], "left").join(who, "cell", "left")
    num = F.coalesce("n", F.lit(0))
    prior = F.coalesce(F.try_divide(num.cast("double"), F.col("deliveries").cast("double")), F.lit(1 / 9))
    mean = F.coalesce(F.try_divide(F.col("runs").cast("double"), F.col("n").cast("double")), F.col("nominal"))
    return g.select("cell", "outcome", num.alias("n"), F.coalesce("players", F.lit(0)).alias("players"), F.coalesce("deliveries", F.lit(0)).alias("deliveries"), prior.alias("prior"), mean.alias("mean_runs"))


def stats_of_players(players: DataFrame) -> DataFrame:
    """``cell_stats`` from ``player_counts``, in which a row is a player."""
    k = F.posexplode(F.arrays_zip("n", "runs")).alias("outcome", "z")
    counts = players.select("cell", "player", k).select("cell", "player", "outcome", "z.n", "z.runs").where("n > 0")
    return cell_stats(counts, players.groupBy("cell").agg(F.count("*").alias("players"), F.sum("total").alias("deliveries")))


def shrink(n: Column, total: Column, prior: Column, kappa: Column) -> Column:
    """(n + kappa * prior) / (total + kappa); the prior itself where that is 0 / 0."""
    return F.coalesce(F.try_divide(n + kappa * prior, total + kappa), prior)


def shrinkage_weight(total: Column, kappa: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), total + kappa), F.lit(0.0))


def by_player(counts: DataFrame) -> DataFrame:
    """(cell, player, total, n): a row for each player and cell with data, its outcomes as an array; one shuffle, shared by all that follow."""
    n = [F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)) for k in OUT]
    return counts.groupBy("cell", "player").agg(F.sum("n").alias("total"), F.array(*n).alias("n"))


def _by_cell(stats: DataFrame, kappas: DataFrame) -> DataFrame:
    """(cell, prior, mean_runs, kappa): twelve rows with arrays by outcome, sent to all tasks."""
    pick = lambda c: F.array(*[F.max(F.when(F.col("outcome") == k, F.col(c))) for k in OUT])
    return F.broadcast(stats.groupBy("cell").agg(pick("prior").alias("prior"), pick("mean_runs").alias("mean_runs")).join(F.broadcast(kappas), "cell"))


def posteriors(counts: DataFrame, stats: DataFrame, players: DataFrame, kappas: DataFrame) -> DataFrame:
    """(cell, player, outcome, n, total, posterior, weight, mean_runs) for every player, cell and outcome; without data the prior with weight 0."""
    # players by the twelve rows of cells, which are of fixed size
    full = players.select("player").crossJoin(_by_cell(stats, kappas)).join(by_player(counts), ["cell", "player"], "left")
    at = lambda c: F.element_at(c, F.col("outcome") + 1)
    df = full.withColumn("outcome", F.explode(F.array(*map(F.lit, OUT))))
    n, total = F.coalesce(at("n"), F.lit(0)), F.coalesce("total", F.lit(0))
    return df.select("cell", "player", "outcome", n.alias("n"), total.alias("total"), shrink(n, total, at("prior"), F.col("kappa")).alias("posterior"), shrinkage_weight(total, F.col("kappa")).alias("weight"), at("mean_runs").alias("mean_runs"), at("prior").alias("prior"))


def cell_rates(post: DataFrame) -> DataFrame:
    """Expected runs, legal share, economy, strike rate and balls a wicket of each player and cell."""
    at = lambda k: F.sum(F.when(F.col("outcome") == k, F.col("posterior")).otherwise(0.0))
    g = post.groupBy("cell", "player").agg(F.sum(F.col("posterior") * F.col("mean_runs")).alias("xr"), at(7).alias("wd"), at(8).alias("nb"), at(6).alias("w"), F.max("total").alias("total"), F.max("weight").alias("weight"))
    legal = 1 - F.col("wd") - F.col("nb")
    return g.select("cell", "player", "total", F.round("weight", 6).alias("weight"), F.round("xr", 6).alias("expected_runs"), F.round(legal, 6).alias("legal_share"), F.round(F.coalesce(F.try_divide(F.col("xr") * 6, legal), F.lit(0.0)), 6).alias("economy"), F.round(F.coalesce(F.try_divide(F.col("xr") * 100, legal), F.lit(0.0)), 6).alias("strike_rate"), F.round(F.coalesce(F.try_divide(legal, F.col("w")), F.lit(0.0)), 6).alias("balls_per_wicket"))


def phase_rates(players: DataFrame, stats: DataFrame, kappas: DataFrame, parts: int | None = None) -> DataFrame:
    """Rates of (player, role, phase) from ``by_player`` or ``player_counts``: its two opposition cells weighted by deliveries, empty ones left out; raw and shrunk. With ``parts``, players are dealt to so many tasks."""
    role, phase, _ = ball.uncell(F.col("cell"))
    n, prior, mean = (lambda k, c=c: F.element_at(c, k + 1) for c in ("n", "prior", "mean_runs"))
    raw = lambda k: F.try_divide(n(k).cast("double"), F.col("total").cast("double"))
    post = lambda k: shrink(n(k), F.col("total"), prior(k), F.col("kappa"))
    total = lambda f, outcomes: sum((f(k) for k in outcomes), F.lit(0.0))
    c = players.where("total > 0").join(_by_cell(stats, kappas), "cell").select(
        "player", role.alias("role"), phase.alias("phase"), "total", shrinkage_weight(F.col("total"), F.col("kappa")).alias("weight"),
        total(lambda k: post(k) * mean(k), OUT).alias("xr"), total(lambda k: raw(k) * mean(k), OUT).alias("rr"), total(post, [7, 8]).alias("xi"), total(raw, [7, 8]).alias("ri"),
    )
    if parts:
        c = c.repartition(parts, "player")
    w = lambda c: (F.sum(F.col(c) * F.col("total")) / F.sum("total"))
    g = c.groupBy("player", "role", "phase").agg(F.sum("total").alias("deliveries"), w("weight").alias("weight"), w("xr").alias("xr"), w("rr").alias("rr"), w("xi").alias("xi"), w("ri").alias("ri"))
    eco = lambda r, i: F.coalesce(F.try_divide(F.col(r) * 6, 1 - F.col(i)), F.lit(0.0))
    return g.select("player", "role", "phase", "deliveries", F.round("weight", 6).alias("weight"), F.round(eco("rr", "ri"), 6).alias("raw_rate"), F.round(eco("xr", "xi"), 6).alias("shrunk_rate"))


def leaderboard(rates: DataFrame, least: int = 200, top: int = 15) -> DataFrame:
    """The best of each role and phase: bowlers by least, batters by most runs an over."""
    key = F.when(F.col("role") == 0, F.col("shrunk_rate")).otherwise(-F.col("shrunk_rate"))
    r = rates.where(F.col("deliveries") >= least).withColumn("place", F.row_number().over(W.partitionBy("role", "phase").orderBy(key, "player")).cast("bigint"))
    return r.where(F.col("place") <= top)


def movers(rates: DataFrame, least: int = 30, top: int = 20) -> DataFrame:
    """Bowlers whom shrinkage moves most."""
    df = rates.where((F.col("role") == 0) & (F.col("deliveries") >= least) & (F.col("raw_rate") != 0)).withColumn("moved", F.round(F.col("shrunk_rate") - F.col("raw_rate"), 6))
    return df.orderBy(F.desc("moved"), "player", "phase").limit(top)


def count_sizes(counts: DataFrame) -> DataFrame:
    """(cell, outcome, n, players): how many players have n of an outcome; outcome -1 stands for all deliveries.

    Players with equal counts add equal terms to a likelihood, so it needs a row
    for each count that occurs, however large the counts are.
    """
    own = counts.groupBy("cell", "player", "outcome").agg(F.sum("n").alias("n"))
    every = own.unionByName(own.groupBy("cell", "player").agg(F.sum("n").alias("n")).withColumn("outcome", F.lit(-1)).select("cell", "player", "outcome", "n"))
    return every.where("n > 0").groupBy("cell", "outcome", "n").agg(F.count("*").alias("players"))


_SHIFT = 10


def log_gamma(x: Column) -> Column:
    """Log-gamma of a positive double, to about 1e-13: Stirling's series ten above."""
    y = x + _SHIFT
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    r = 1 / (y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 + r * (-1 / 360 + r * (1 / 1260 + r * (-1 / 1680 + r / 1188)))) / y - F.log(product)


def digamma_rise(a: Column, n: Column) -> Column:
    """The sum of 1 / (a + j) for j below n: the derivative of log-gamma at a + n less that at a.

    Each part of the series is a difference of its own, so that little is lost where n is far below a.
    """
    y, z = a + _SHIFT, a + n + _SHIFT
    below = sum((n / ((a + i) * (a + n + i)) for i in range(1, _SHIFT)), n / (a * (a + n)))
    series = lambda r: r * r * (-1 / 120 + r * (1 / 252 + r * (-1 / 240 + r / 132)))
    return F.log1p(n / y) + n / (2 * y * z) + n * (y + z) / (12 * y * y * z * z) + below - (series(1 / (z * z)) - series(1 / (y * y)))


def log_marginal(sizes: DataFrame, stats: DataFrame, kappas: DataFrame) -> DataFrame:
    """(cell, log_marginal) at the given concentration of each cell (columns cell, kappa)."""
    t = sizes.join(F.broadcast(stats.select("cell", "outcome", "prior")), ["cell", "outcome"], "left").join(F.broadcast(kappas), "cell")
    a = F.when(F.col("outcome") == -1, F.col("kappa")).otherwise(F.col("kappa") * F.col("prior"))
    term = F.when(a > 0, log_gamma(F.col("n") + a) - log_gamma(a)).otherwise(0.0)
    return t.groupBy("cell").agg(F.sum(F.when(F.col("outcome") == -1, -term).otherwise(term) * F.col("players")).alias("log_marginal"))


def marginal_slope(sizes: DataFrame, kappas: DataFrame) -> DataFrame:
    """(cell, i, slope): the derivative of the log marginal likelihood by kappa at (cell, i, kappa); ``sizes`` with their prior."""
    t = sizes.join(F.broadcast(kappas), "cell")
    share = F.when(F.col("outcome") == -1, F.lit(1.0)).otherwise(F.col("prior"))
    a = F.col("kappa") * share
    term = F.when(a > 0, share * digamma_rise(a, F.col("n").cast("double"))).otherwise(0.0)
    return t.groupBy("cell", "i").agg(F.sum(F.when(F.col("outcome") == -1, -term).otherwise(term) * F.col("players")).alias("slope"))


def fit_concentration(counts: DataFrame, stats: DataFrame, points: int = 32, rounds: int = 5) -> DataFrame:
    """(cell, kappa) that maximises each cell's marginal likelihood; 1e6 with data of fewer than two players.

    The likelihood has one maximum, where its slope turns from above 0. A round sums
    the slope of all cells at ``points`` places of the log of kappa between each
    cell's bounds, and keeps the interval in which it turns; so a fit is ``rounds``
    jobs, each a partial sum of a row a count, and the driver sees cells x points.
    """
    lo, hi = (math.log(k) for k in KAPPA_RANGE)
    known = {r.cell: r.players for r in counts.groupBy("cell").agg(F.count_distinct("player").alias("players")).collect()}
    bounds = {c: (lo, hi) for c, n in known.items() if n >= 2}
    spark = counts.sparkSession
    sizes = written(count_sizes(counts).join(F.broadcast(stats.select("cell", "outcome", "prior")), ["cell", "outcome"], "left"), "sizes")
    for _ in range(rounds if bounds else 0):
        at = {(c, i): a + (b - a) * i / points for c, (a, b) in bounds.items() for i in range(points + 1)}
        grid = spark.createDataFrame([(c, i, math.exp(t)) for (c, i), t in at.items()], "cell int, i int, kappa double")
        falls = {}
        for r in marginal_slope(sizes, grid).collect():
            if r.slope <= 0:
                falls[r.cell] = min(r.i, falls.get(r.cell, points + 1))
        bounds = {c: (at[c, max(0, falls.get(c, points + 1) - 1)], at[c, min(points, falls.get(c, points))]) for c in bounds}
    return spark.createDataFrame([(c, math.exp(sum(bounds[c]) / 2) if c in bounds else KAPPA_RANGE[1]) for c in known], "cell int, kappa double")

def bowler_quality(rates: DataFrame) -> DataFrame:
    """Quality 0 to 1 and price of bowlers from their phases' shrunk economy (weights .5 death, .3 middle, .2 powerplay)."""
    weight = F.when(F.col("phase") == 2, 0.5).when(F.col("phase") == 1, 0.3).otherwise(0.2)
    one = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11 - F.col("shrunk_rate")) / 3.5))
    g = rates.where("role = 0").groupBy("player").agg(F.sum(weight * one).alias("q"), F.sum(weight).alias("w"))
    q = F.col("q") / F.col("w")
    return g.select("player", F.round(q, 6).alias("quality"), price(q).alias("cost"))


def price(q: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(20), F.floor(3 + 17 * q + 0.5).cast("int")))


def batter_quality(rates: DataFrame, v: DataFrame) -> DataFrame:
    """Quality of batters: strike rate by phase (.4, .35, .25) for seven tenths, survival for three."""
    weight = F.when(F.col("phase") == 2, 0.4).when(F.col("phase") == 1, 0.35).otherwise(0.25)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    g = rates.where("role = 1").groupBy("player").agg((F.sum(weight * F.col("shrunk_rate") * 100 / 6) / F.sum(weight)).alias("sr"))
    d = g.join(v.select("player", "faced", "dismissals"), "player")
    survival = F.when(F.col("dismissals") == 0, 0.5).otherwise(clamp((F.try_divide(F.col("faced").cast("double"), F.col("dismissals").cast("double")) - 12) / 18))
    q = 0.7 * clamp((F.col("sr") - 110) / 55) + 0.3 * survival
    return d.select("player", F.round(q, 6).alias("quality"), price(q).alias("cost"))


def draft_pool(bowlers: DataFrame, batters: DataFrame, v: DataFrame) -> DataFrame:
    """Those who may be drafted, by cost and id: bowlers with 400 balls and any quality, batters with 500, 11 an innings and quality 0.2."""
    v = v.select("player", "bowled", "faced", "innings")
    a = bowlers.join(v, "player").where("bowled >= 400 AND quality > 0").select(F.lit("bowler").alias("role"), "player", "quality", "cost")
    b = batters.join(v, "player").where("faced >= 500 AND faced >= 11 * innings AND quality >= 0.2").select(F.lit("batter").alias("role"), "player", "quality", "cost")
    return a.unionByName(b)


def affordable(costs: list[int], squad: int, budget: int, least: int = 3) -> list[int]:
    """Lowers every cost above ``least`` by one until the cheapest ``squad`` fit the budget."""
    costs = list(costs)
    while sum(sorted(costs)[:squad]) > budget and any(c > least for c in costs):
        costs = [c - 1 if c > least else c for c in costs]
    return costs
