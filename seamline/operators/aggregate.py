"""Filters, distributions, career roll-ups, eligibility and the matchup graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import ball

#: Rows of a dimension that are sent to all tasks rather than dealt.
BROADCAST_ROWS = 250_000


def meet(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int | None = None, small: int | None = None) -> DataFrame:
    """The join by ``key``. With ``parts``, both sides are dealt to so many tasks, however few Spark would take, so that what a task sorts does not grow with them; at most ``small`` rows on the right are broadcast instead."""
    if parts:
        small = BROADCAST_ROWS if small is None else small
        if small and right.count() <= small:
            right = F.broadcast(right)
        else:
            left, right = left.repartition(parts, key), right.repartition(parts, key)
    return left.join(right, key, how)


def classified(d: DataFrame) -> DataFrame:
    """Adds total, bruns, extras, legal, phase, credited, costs and outcome."""
    return d.withColumns({
        "total": ball.total_runs(), "bruns": ball.bowler_runs(), "extras": ball.extras(), "legal": ball.is_legal(), "phase": ball.phase(),
        "credited": ball.credited(), "costs": ball.costs_wicket(), "outcome": ball.outcome(),
    })


@dataclass(frozen=True)
class Filter:
    """Conditions that must all hold; None leaves one out. ``hands`` and ``classes`` are semi-joins with attributes, where unknown never matches."""

    bowler: int | None = None
    batter: int | None = None
    overs: tuple[int, int] | None = None
    seasons: tuple[int | None, int | None] = (None, None)
    phase: str | None = None
    hand: str | None = None
    bowl_class: str | None = None
    super_overs: bool = False

    def column(self) -> Column:
        c = F.lit(True) if self.super_overs else ~F.col("super_over")
        if self.bowler is not None:
            c &= F.col("bowler") == self.bowler
        if self.batter is not None:
            c &= F.col("batter") == self.batter
        if self.overs:
            c &= F.col("over").between(*self.overs)
        if self.phase:
            c &= ball.in_phase(self.phase)
        lo, hi = self.seasons
        if lo:
            c &= F.col("season") >= lo
        if hi:
            c &= F.col("season") <= hi
        return c

    def apply(self, d: DataFrame, bat_attr: DataFrame | None = None, bowl_attr: DataFrame | None = None) -> DataFrame:
        d = d.where(self.column())
        if self.hand:
            d = d.join(bat_attr.where(F.col("hand") == self.hand).select(F.col("player").alias("batter")), "batter", "left_semi")
        if self.bowl_class:
            d = d.join(bowl_attr.where(F.col("bowl_class") == self.bowl_class).select(F.col("player").alias("bowler")), "bowler", "left_semi")
        return d


def parse_range(text: str, lowest: int = 1, highest: int = 20) -> tuple[int, int]:
    """"15-19" as two numbers, counted from 0; a single number is no range."""
    a, dash, b = text.partition("-")
    if not dash or not a.strip().isdigit() or not b.strip().isdigit():
        raise ValueError(f"{text!r} is not a range like 15-19")
    lo, hi = int(a), int(b)
    if not lowest <= lo <= hi <= highest:
        raise ValueError(f"range {text!r} is outside {lowest}-{highest}")
    return lo - 1, hi - 1


def range_of(text: Column, lowest: int = 1, highest: int = 20) -> tuple[Column, Column]:
    """``parse_range`` of a column: (first, last) counted from 0, nulls where it would be an error."""
    lo, hi = (F.nullif(F.regexp_extract(text, r"^\s*([0-9]{1,9})\s*-\s*([0-9]{1,9})\s*$", i), F.lit("")).cast("int") for i in (1, 2))
    right = (lo >= lowest) & (lo <= hi) & (hi <= highest)
    return F.when(right, lo - 1), F.when(right, hi - 1)


def _count(c: Column | str, name: str) -> Column:
    return F.count_if(F.expr(c) if isinstance(c, str) else c).alias(name)


def _sum(c: str, name: str) -> Column:
    return F.coalesce(F.sum(F.expr(c).cast("bigint")), F.lit(0)).alias(name)


def distribution(x: DataFrame) -> DataFrame:
    """One row of counts over classified rows; zeros, not nulls, when there are none."""
    return x.agg(
        F.count("*").alias("deliveries"), _count("legal", "legal"), *[_count(f"outcome = {i}", name) for i, name in enumerate(f"n_{n}" for n in ball.OUTCOMES)],
        _sum("runs_bat", "bat_runs"), _sum("extras", "extras"), _sum("total", "total"), _count("costs", "wickets"), _count("costs AND credited", "bowler_wickets"),
    )


def with_rates(dist: DataFrame) -> DataFrame:
    r = ball.ratio
    return dist.withColumns({
        "economy": F.round(r(F.col("bat_runs") + F.col("extras"), F.col("legal"), 6), 6), "strike_rate": F.round(r(F.col("bat_runs"), F.col("legal"), 100), 6),
        "boundary_rate": F.round(r(F.col("n_four") + F.col("n_six"), F.col("legal")), 6), "dot_rate": F.round(r(F.col("n_dot"), F.col("legal")), 6),
        "balls_per_wicket": F.round(r(F.col("legal"), F.col("bowler_wickets")), 6),
    })


def outcome_histogram(x: DataFrame) -> DataFrame:
    """All nine outcomes with count and share of all deliveries."""
    names = x.sparkSession.createDataFrame(list(enumerate(ball.OUTCOMES)), "outcome int, name string")
    n = x.groupBy("outcome").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    df = F.broadcast(names).join(n, "outcome", "left").crossJoin(total)  # one row
    return df.select("outcome", "name", F.coalesce("n", F.lit(0)).alias("n"), F.round(ball.ratio(F.coalesce("n", F.lit(0)), F.coalesce("all", F.lit(0))), 6).alias("share"))


def volumes(x: DataFrame, players: DataFrame, parts: int | None = None) -> DataFrame:
    """Both roles of every player in one pass: each ball gives a row to its batter, its bowler and the player out. With ``parts``, these rows are dealt to so many tasks by player."""
    x = x.where(~F.col("super_over"))
    roles = F.array(
        F.struct(F.col("batter").alias("player"), F.col("legal").cast("int").alias("faced"), F.col("runs_bat").alias("runs"), F.lit(0).alias("out"), F.lit(0).alias("bowled"), F.lit(0).alias("conceded"), F.lit(0).alias("taken"), F.lit(True).alias("on")),
        F.struct(F.col("bowler").alias("player"), F.lit(0).alias("faced"), F.lit(0).alias("runs"), F.lit(0).alias("out"), F.col("legal").cast("int").alias("bowled"), F.col("bruns").alias("conceded"), (F.col("costs") & F.col("credited")).cast("int").alias("taken"), F.lit(True).alias("on")),
        F.struct(F.col("player_out").alias("player"), F.lit(0).alias("faced"), F.lit(0).alias("runs"), F.col("costs").cast("int").alias("out"), F.lit(0).alias("bowled"), F.lit(0).alias("conceded"), F.lit(0).alias("taken"), F.lit(False).alias("on")),
    )
    long = x.select("innings_id", "season", F.explode(roles).alias("r")).select("innings_id", "season", "r.*").where("player IS NOT NULL")
    if parts:
        long, players = long.repartition(parts, "player"), players.repartition(parts, "player")
    sums = long.groupBy("player").agg(
        _sum("faced", "faced"), _sum("runs", "runs"), _sum("out", "dismissals"), _sum("bowled", "bowled"), _sum("conceded", "conceded"), _sum("taken", "wickets"),
        F.count_distinct(F.when(F.col("on"), F.col("innings_id"))).alias("innings"), F.min(F.when(F.col("on"), F.col("season"))).alias("first_season"), F.max(F.when(F.col("on"), F.col("season"))).alias("last_season"),
    )
    df = players.select("player").join(sums, "player", "left")
    return df.select("player", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("faced", "runs", "dismissals", "bowled", "conceded", "wickets", "innings")], F.coalesce("first_season", F.lit(0)).alias("first_season"), F.coalesce("last_season", F.lit(0)).alias("last_season"))


def careers(x: DataFrame) -> DataFrame:
    """Spells (player, team): innings, first and last season; strikers and non-strikers for the batting team, bowlers for the other."""
    roles = F.array(*[F.struct(F.col(p).alias("player"), F.col(t).alias("team")) for p, t in (("batter", "batting_team"), ("non_striker", "batting_team"), ("bowler", "bowling_team"))])
    long = x.where(~F.col("super_over")).select("innings_id", "season", F.explode(roles).alias("r")).select("innings_id", "season", "r.*").where("player IS NOT NULL")
    return long.groupBy("player", "team").agg(F.count_distinct("innings_id").alias("innings"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


def career_labels(spells: DataFrame, canonical: dict[int, int]) -> DataFrame:
    """The club of each player: renamed teams folded; of the spells by last season, innings and team, a later one wins only with more than twice the innings."""
    pairs = [F.lit(v) for kv in canonical.items() for v in kv]
    team = F.coalesce(F.create_map(*pairs)[F.col("team")], F.col("team")) if pairs else F.col("team")
    folded = spells.withColumn("team", team).groupBy("player", "team").agg(F.sum("innings").alias("innings"), F.min("first_season").alias("f"), F.max("last_season").alias("l"))
    listed = folded.groupBy("player").agg(F.array_sort(F.collect_list(F.struct((-F.col("l")).alias("nl"), (-F.col("innings")).alias("ni"), "team"))).alias("s"), F.min("f").alias("first_season"), F.max("l").alias("last_season"))
    pick = F.aggregate(F.slice("s", 2, 1000), F.element_at("s", 1), lambda a, b: F.when(-b["ni"] > -a["ni"] * 2, b).otherwise(a))
    years = F.when(F.col("first_season") == F.col("last_season"), F.col("first_season").cast("string")).otherwise(F.concat_ws("-", "first_season", "last_season"))
    return listed.select("player", pick["team"].alias("team"), years.alias("years"))


def eligible(v: DataFrame, bowled: int = 120, faced: int = 200, since: int = 0) -> DataFrame:
    """Volumes of players with enough in a role; ``since`` takes both roles from players last seen before it."""
    recent = F.col("last_season") >= since
    v = v.withColumn("as_bowler", (F.col("bowled") >= bowled) & recent).withColumn("as_batter", (F.col("faced") >= faced) & recent)
    return v.where("as_bowler OR as_batter")


def dealable(e: DataFrame, bat_attr: DataFrame, bowl_attr: DataFrame, bowled: int = 120) -> DataFrame:
    """Eligible players with roles whose attributes are known, and why the others are left out (null for none)."""
    df = e.join(bat_attr, "player", "left").join(bowl_attr, "player", "left")
    reason = F.concat_ws(", ", F.when(F.col("hand").isNull(), "hand unknown"), F.when((F.col("bowled") >= bowled) & F.col("bowl_class").isNull(), "class unknown"))
    out = df.withColumn("deal_bowler", F.col("as_bowler") & F.col("bowl_class").isNotNull() & F.col("hand").isNotNull()).withColumn("deal_batter", F.col("as_batter") & F.col("hand").isNotNull())
    return out.withColumn("excluded", ~(F.col("deal_bowler") | F.col("deal_batter"))).withColumn("reason", F.when(F.col("excluded"), reason))


def edges(x: DataFrame, max_season: int | None = None) -> DataFrame:
    """The matchup graph: a row a (batter, bowler) that met outside super overs."""
    x = x.where(~F.col("super_over") & F.col("batter").isNotNull() & F.col("bowler").isNotNull())
    if max_season:
        x = x.where(F.col("season") <= max_season)
    return x.groupBy("batter", "bowler").agg(_count("legal", "balls"), _sum("runs_bat", "runs"), _count("costs AND credited AND player_out = batter", "outs"), _count("outcome = 0", "dots"), _count("outcome = 4", "fours"), _count("outcome = 5", "sixes"))


def edge_rates(e: DataFrame) -> DataFrame:
    """Strike rate (0 without balls) and average (null if never out)."""
    return e.withColumn("strike_rate", F.round(ball.ratio(F.col("runs"), F.col("balls"), 100), 6)).withColumn("average", F.round(F.try_divide(F.col("runs").cast("double"), F.col("outs").cast("double")), 6))


def degrees(e: DataFrame) -> DataFrame:
    a = e.groupBy(F.col("batter").alias("player")).agg(F.count("*").alias("bowlers_faced"))
    b = e.groupBy(F.col("bowler").alias("player")).agg(F.count("*").alias("batters_bowled"))
    return a.join(b, "player", "full_outer").select("player", F.coalesce("bowlers_faced", F.lit(0)).alias("bowlers_faced"), F.coalesce("batters_bowled", F.lit(0)).alias("batters_bowled"))


def graph_stats(e: DataFrame, players: DataFrame) -> DataFrame:
    """Nodes, edges, density, and the player of the highest degree on each side, the least id of equals."""
    d = degrees(e)
    n = players.agg(F.count_distinct("player").alias("nodes"))
    top = d.agg(F.sum("bowlers_faced").alias("edges"), F.max_by("player", F.struct("bowlers_faced", -F.col("player"))).alias("top_batter"), F.max_by("player", F.struct("batters_bowled", -F.col("player"))).alias("top_bowler"))
    return top.crossJoin(n).select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes").cast("double") * F.col("nodes")), 9).alias("density"), "top_batter", "top_bowler")


def worst_matchups(e: DataFrame, batter: int, least: int = 30, limit: int = 15) -> DataFrame:
    """A batter's bowlers by strike rate, highest first."""
    return edge_rates(e.where((F.col("batter") == batter) & (F.col("balls") >= least))).orderBy(F.desc("strike_rate"), "bowler").limit(limit)


def pick_top(v: DataFrame, since: int, n: int, measure: str) -> DataFrame:
    return v.where((F.col("last_season") >= since) & (F.col(measure) > 0)).orderBy(F.desc(measure), "player").limit(n)


def name_multiplicity(sightings: DataFrame) -> DataFrame:
    """Of (name, id): names with several ids and ids with several names, each with its sorted list."""
    both = []
    for what, other in (("name", "id"), ("id", "name")):
        g = sightings.groupBy(F.col(what).cast("string").alias("value")).agg(F.array_join(F.array_sort(F.collect_set(F.col(other).cast("string"))), ",").alias("others"), F.count_distinct(other).alias("n"))
        both.append(g.where("n >= 2").select(F.lit(what).alias("kind"), "value", "n", "others"))
    return both[0].unionByName(both[1])


def preferred_names(sightings: DataFrame) -> DataFrame:
    """The name of each id: most frequent, then longest, then first in order."""
    g = sightings.groupBy("id", "name").agg(F.count("*").alias("n"))
    w = W.partitionBy("id").orderBy(F.desc("n"), F.desc(F.length("name")), "name")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "name", "n")


def counters(x: DataFrame) -> DataFrame:
    """Totals, by phase and by season in one pass; a null marks the grouping that is not in use."""
    g = x.groupingSets([["phase"], ["season"], []], "phase", "season")
    return g.agg(F.count("*").alias("deliveries"), _count("legal", "legal"), _sum("extras", "extras"), _count("wicket IS NOT NULL", "wickets"))


def venue_rates(x: DataFrame, least: int = 600, max_season: int | None = None) -> DataFrame:
    """Runs a legal ball at each venue; the overall rate where fewer than ``least`` legal balls were bowled."""
    if max_season:
        x = x.where(F.col("season") <= max_season)
    v = x.groupBy("venue").agg(_sum("total", "total"), _count("legal", "legal"))
    w = v.agg(F.sum("total").alias("all_total"), F.sum("legal").alias("all_legal"))
    rate = F.when(F.col("legal") >= least, ball.ratio(F.col("total"), F.col("legal"))).otherwise(ball.ratio(F.col("all_total"), F.col("all_legal")))
    return v.crossJoin(w).select("venue", "legal", F.round(rate, 6).alias("run_rate"))


def bowling_signature(x: DataFrame, attr: dict[str, float] | None = None) -> DataFrame:
    """Phase shares, rare events and a guess of spin or pace for each bowler, with a confidence."""
    g = x.where(~F.col("super_over")).groupBy("bowler").agg(
        _count("legal", "legal"), _count("legal AND phase = 'powerplay'", "pp"), _count("legal AND phase = 'middle'", "mid"), _count("legal AND phase = 'death'", "death"), _count("wicket = 'stumped'", "stumpings"), _sum("noballs", "noballs")
    ).where("legal > 0")
    share = lambda c: F.col(c) / F.col("legal").cast("double")
    score = F.when(F.col("stumpings") >= 3, 2.0).when(F.col("stumpings") >= 1, 1.2).otherwise(0.0) + 2 * (share("mid") - 0.5) - 2 * (share("pp") + share("death") - 0.5) - 20 * share("noballs")
    g = g.withColumn("score", score)
    conf = F.least(F.abs("score") / 2.5, F.lit(0.95)) * F.when(F.col("legal") < 300, F.col("legal") / F.lit(300.0)).otherwise(1.0)
    return g.select("bowler", "legal", F.round(share("pp"), 6).alias("pp_share"), F.round(share("mid"), 6).alias("mid_share"), F.round(share("death"), 6).alias("death_share"), F.round("score", 6).alias("score"), F.when(F.col("score") > 0, "spin").otherwise("pace").alias("guess"), F.round(conf, 6).alias("confidence"))
