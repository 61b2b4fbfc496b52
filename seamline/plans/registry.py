"""Queries over the driver's tables: name -> (query of (spark, sf_dir), DuckDB SQL or None).

A name starts with the inventory ids of the operators that it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import ball
from seamline.operators import aggregate as ag
from seamline.operators import features as ft
from seamline.operators import names as na
from seamline.operators import rates as ra
from seamline.operators import results as re_
from seamline.operators import windows as wi
from seamline.plans import views as v
from seamline.session import ship, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

_CREDITED = ", ".join(f"'{k}'" for k in ball.CREDITED)
_X = f"""SELECT *, runs_bat + wides + noballs + byes + legbyes + penalty AS total, runs_bat + wides + noballs AS bruns, wides + noballs + byes + legbyes + penalty AS extras,
  wides = 0 AND noballs = 0 AS legal, CASE WHEN over < 6 THEN 'powerplay' WHEN over < 15 THEN 'middle' ELSE 'death' END AS phase, coalesce(wicket IN ({_CREDITED}), false) AS credited,
  wicket IS NOT NULL AND wicket <> 'retired hurt' AS costs,
  CASE WHEN wicket IS NOT NULL AND wicket <> 'retired hurt' THEN 6 WHEN wides > 0 THEN 7 WHEN noballs > 0 THEN 8 WHEN runs_bat >= 6 THEN 5 WHEN runs_bat >= 4 THEN 4 ELSE runs_bat END AS outcome FROM d"""


def L(sql: str) -> str:
    return f"WITH d AS ({v.RELATIONAL_SQL}), x AS ({_X}), bat AS ({v.BATTING_SQL}), bowl AS ({v.BOWLING_SQL}){sql}"


def E(sql: str) -> str:
    return f"WITH d AS ({v.ORDERED_SQL}), x AS ({_X}), runs AS ({v.RESULTS_SQL}), bat AS (SELECT DISTINCT batter AS player, CASE batter % 3 WHEN 0 THEN 'RHB' WHEN 1 THEN 'LHB' END AS hand FROM d), bowl AS (SELECT DISTINCT bowler AS player, CASE bowler % 7 WHEN 1 THEN 'RAP' WHEN 2 THEN 'LAP' WHEN 3 THEN 'OB' WHEN 4 THEN 'LB' WHEN 5 THEN 'SLA' WHEN 6 THEN 'SLW' END AS bowl_class FROM d){sql}"


def lx(s: SparkSession, d: str) -> DataFrame:
    return ag.classified(v.relational(s, d))


def ex(s: SparkSession, d: str) -> DataFrame:
    return ag.classified(v.ordered(s, d))


def e_bat(x: DataFrame) -> DataFrame:
    return x.select(F.col("batter").alias("player")).distinct().withColumn("hand", F.expr("CASE player % 3 WHEN 0 THEN 'RHB' WHEN 1 THEN 'LHB' END"))


def e_bowl(x: DataFrame) -> DataFrame:
    return x.select(F.col("bowler").alias("player")).distinct().withColumn("bowl_class", F.expr("CASE player % 7 WHEN 1 THEN 'RAP' WHEN 2 THEN 'LAP' WHEN 3 THEN 'OB' WHEN 4 THEN 'LB' WHEN 5 THEN 'SLA' WHEN 6 THEN 'SLW' END"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return add


_OUTCOMES = ", ".join(f"count(*) FILTER (outcome = {i}) AS n_{n}" for i, n in enumerate(ball.OUTCOMES))
_DIST = f"count(*) AS deliveries, count(*) FILTER (legal) AS legal, {_OUTCOMES}, coalesce(sum(runs_bat), 0)::BIGINT AS bat_runs, coalesce(sum(extras), 0)::BIGINT AS extras, coalesce(sum(total), 0)::BIGINT AS total, count(*) FILTER (costs) AS wickets, count(*) FILTER (costs AND credited) AS bowler_wickets"
_RATES = "round(coalesce(6.0 * (bat_runs + extras) / nullif(legal, 0), 0), 6) AS economy, round(coalesce(100.0 * bat_runs / nullif(legal, 0), 0), 6) AS strike_rate, round(coalesce((n_four + n_six)::DOUBLE / nullif(legal, 0), 0), 6) AS boundary_rate, round(coalesce(n_dot::DOUBLE / nullif(legal, 0), 0), 6) AS dot_rate, round(coalesce(legal::DOUBLE / nullif(bowler_wickets, 0), 0), 6) AS balls_per_wicket"


def _dist_sql(where: str) -> str:
    return f" SELECT *, {_RATES} FROM (SELECT {_DIST} FROM x WHERE {where}) g"


@query("A1_P9_P10_P16_J1_J2_dist", L(_dist_sql("NOT super_over AND over BETWEEN 15 AND 19 AND season >= 1996 AND batter IN (SELECT player FROM bat WHERE hand = 'LHB') AND bowler IN (SELECT player FROM bowl WHERE bowl_class = 'OB')")))
def dist(s: SparkSession, d: str) -> DataFrame:
    f = ag.Filter(phase="death", hand="LHB", bowl_class="OB", seasons=(1996, None))
    return ag.with_rates(ag.distribution(f.apply(lx(s, d), v.batting_attributes(s, d), v.bowling_attributes(s, d))))


@query("A1_J9_dist_empty", L(_dist_sql("NOT super_over AND season BETWEEN 2050 AND 2051 AND over BETWEEN 3 AND 9")))
def dist_empty(s: SparkSession, d: str) -> DataFrame:
    return ag.with_rates(ag.distribution(ag.Filter(overs=(3, 9), seasons=(2050, 2051)).apply(lx(s, d))))


@query("P1_P2_P3_P4_P5_P6_P8_classify", L(" SELECT season, phase, outcome, count(*) AS n, count(*) FILTER (legal) AS legal, sum(total)::BIGINT AS total, sum(bruns)::BIGINT AS bowler_runs, count(*) FILTER (credited) AS credited, count(*) FILTER (costs) AS costs FROM x GROUP BY ALL"))
def classify(s: SparkSession, d: str) -> DataFrame:
    return lx(s, d).groupBy("season", "phase", "outcome").agg(F.count("*").alias("n"), F.count_if("legal").alias("legal"), F.sum("total").alias("total"), F.sum("bruns").alias("bowler_runs"), F.count_if("credited").alias("credited"), F.count_if("costs").alias("costs"))


@query("P13_P14_J3_moves_away", L("""
 SELECT hand, bowl_class, hand IS NOT NULL AS hand_known, bowl_class IS NOT NULL AS class_known,
  coalesce((hand = 'RHB' AND bowl_class IN ('LB', 'SLA', 'LAP')) OR (hand = 'LHB' AND bowl_class IN ('OB', 'SLW', 'RAP')), false) AS moves_away,
  coalesce(bowl_class IN ('OB', 'LB', 'SLA', 'SLW'), false) AS is_spin, coalesce(bowl_class IN ('RAP', 'LAP'), false) AS is_pace, count(*) AS n
 FROM x LEFT JOIN bat ON bat.player = batter LEFT JOIN bowl ON bowl.player = bowler GROUP BY ALL"""))
def moves(s: SparkSession, d: str) -> DataFrame:
    j = v.relational(s, d).join(v.batting_attributes(s, d).withColumnRenamed("player", "batter"), "batter", "left").join(v.bowling_attributes(s, d).withColumnRenamed("player", "bowler"), "bowler", "left")
    c, h = F.col("bowl_class"), F.col("hand")
    return j.groupBy("hand", "bowl_class", h.isNotNull().alias("hand_known"), c.isNotNull().alias("class_known"), ball.moves_away(c, h).alias("moves_away"), ball.is_spin(c).alias("is_spin"), ball.is_pace(c).alias("is_pace")).agg(F.count("*").alias("n"))


@query("P15_cells", "SELECT i::INT AS cell, (i // 6)::INT AS role, (i // 2 % 3)::INT AS phase, (i % 2)::INT AS opposition, (((i // 6) * 3 + i // 2 % 3) * 2 + i % 2)::INT AS again FROM range(12) t(i)")
def cells(s: SparkSession, d: str) -> DataFrame:
    df = s.range(12).select(F.col("id").cast("int").alias("cell"))
    r, p, o = (c.cast("int") for c in ball.uncell(F.col("cell")))
    return df.select("cell", r.alias("role"), p.alias("phase"), o.alias("opposition"), ball.cell(r, p, o).alias("again"))


@query("P17_J8_edge_lookup", L("""
, e AS (SELECT batter, bowler, count(*) FILTER (legal) AS balls, sum(runs_bat)::BIGINT AS runs, count(*) FILTER (costs AND credited AND player_out = batter) AS outs FROM x WHERE NOT super_over GROUP BY ALL)
 SELECT p.player, p.bowler, coalesce(balls, 0) AS balls, coalesce(round(coalesce(100.0 * runs / nullif(balls, 0), 0), 6), 0) AS strike_rate, round(runs::DOUBLE / nullif(outs, 0), 6) AS average
 FROM (SELECT batter AS player, bowler FROM e UNION SELECT player, -1 FROM bat) p LEFT JOIN e ON e.batter = p.player AND e.bowler = p.bowler"""))
def edge_lookup(s: SparkSession, d: str) -> DataFrame:
    e = ag.edge_rates(ag.edges(lx(s, d)))
    # all pairs that met, and one that never did for each batter
    grid = e.select("batter", "bowler").union(v.batting_attributes(s, d).select("player", F.lit(-1).cast("bigint")))
    return grid.join(e, ["batter", "bowler"], "left").select(F.col("batter").alias("player"), "bowler", F.coalesce("balls", F.lit(0)).alias("balls"), F.coalesce("strike_rate", F.lit(0.0)).alias("strike_rate"), "average")


@query("P18_W10_over_grades", E("""
, o AS (SELECT innings_id, over, min(delivery_id) AS at FROM x WHERE NOT super_over GROUP BY ALL), b AS (SELECT o.*, x.runs_bat / 100.0::DOUBLE AS before FROM o JOIN x ON x.delivery_id = o.at),
 w AS (SELECT *, lead(before) OVER (PARTITION BY innings_id ORDER BY over) - before AS delta FROM b)
 SELECT innings_id, over, round(delta, 6) AS delta, CASE WHEN delta > 0.03 THEN 'good' WHEN delta < -0.03 THEN 'bad' ELSE 'level' END AS grade FROM w"""))
def over_grades(s: SparkSession, d: str) -> DataFrame:
    w = wi.over_deltas(ex(s, d).where("NOT super_over"), F.col("runs_bat") / 100.0)
    return w.select("innings_id", "over", F.round("delta", 6).alias("delta"), ball.grade(F.col("delta")).alias("grade"))


@query("P19_S11_season_split", L(" SELECT season, CASE WHEN season <= (SELECT max(season) FROM x) - 2 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM x GROUP BY ALL"))
def split(s: SparkSession, d: str) -> DataFrame:
    return ft.season_split(lx(s, d).select("season")).groupBy("season", "split").agg(F.count("*").alias("n"))


_TERMS = ["nobody", "12", "4", "customer#00000001", "Customer#000000007", "CUSTOMER", "", "g 79"]


@query("P12_name_resolution", f"""
WITH c AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment || ' ' || (c_custkey * 7919 % 100003) AS alias FROM customer), q AS (SELECT DISTINCT term FROM (SELECT unnest({_TERMS}) AS term UNION ALL SELECT name FROM c UNION ALL SELECT 'k' || id FROM c UNION ALL SELECT lower(substr(alias, 3, 16)) FROM c UNION ALL SELECT right(alias, 7) FROM c)),
 t AS (SELECT term, id, CASE WHEN id = term THEN 1 WHEN name = term THEN 2 WHEN contains(lower(name), lower(term)) OR contains(lower(alias), lower(term)) THEN 3 END AS tier FROM q, c WHERE term <> ''), m AS (SELECT * FROM t WHERE tier IS NOT NULL), b AS (SELECT term, min(tier) AS best FROM m GROUP BY term),
 h AS (SELECT q.term, coalesce(b.best, 0)::INT AS tier, count(m.id) AS hits, min(m.id) AS first_id FROM q LEFT JOIN b ON b.term = q.term LEFT JOIN m ON m.term = q.term AND m.tier = b.best GROUP BY ALL)
SELECT *, CASE hits WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS status FROM h""")
def resolve(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.array(F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") * 7919 % 100003).cast("string"))).alias("aliases"))
    a = F.get("aliases", F.lit(0))
    asked = c.select(F.explode(F.array("name", F.concat(F.lit("k"), "id"), F.lower(F.substring(a, 3, 16)), F.right(a, F.lit(7)))).alias("term"))
    return na.resolve(asked.unionByName(s.createDataFrame([(t,) for t in _TERMS], "term string")), c)


_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ball.OUTCOMES))


@query("A2_outcome_histogram", L(f" SELECT o.i AS outcome, o.name, count(x.outcome) AS n, round(count(x.outcome)::DOUBLE / (SELECT count(*) FROM x), 6) AS share FROM (VALUES {_NAMES}) o(i, name) LEFT JOIN x ON x.outcome = o.i GROUP BY ALL"))
def histogram(s: SparkSession, d: str) -> DataFrame:
    return ag.outcome_histogram(lx(s, d))


_VOLUMES = """
, r AS (SELECT innings_id, season, batter AS player, legal::INT AS faced, runs_bat AS runs, 0 AS o, 0 AS bowled, 0 AS conceded, 0 AS taken, true AS is_on FROM x WHERE NOT super_over
 UNION ALL SELECT innings_id, season, bowler, 0, 0, 0, legal::INT, bruns, (costs AND credited)::INT, true FROM x WHERE NOT super_over
 UNION ALL SELECT innings_id, season, player_out, 0, 0, costs::INT, 0, 0, 0, false FROM x WHERE NOT super_over AND player_out IS NOT NULL),
 vv AS (SELECT player, sum(faced)::BIGINT AS faced, sum(runs)::BIGINT AS runs, sum(o)::BIGINT AS dismissals, sum(bowled)::BIGINT AS bowled, sum(conceded)::BIGINT AS conceded, sum(taken)::BIGINT AS wickets, count(DISTINCT CASE WHEN is_on THEN innings_id END) AS innings,
  min(CASE WHEN is_on THEN season END) AS first_season, max(CASE WHEN is_on THEN season END) AS last_season FROM r GROUP BY player),
 pl AS (SELECT c_custkey::BIGINT AS player FROM customer),
 vol AS (SELECT pl.player, coalesce(faced, 0) AS faced, coalesce(runs, 0) AS runs, coalesce(dismissals, 0) AS dismissals, coalesce(bowled, 0) AS bowled, coalesce(conceded, 0) AS conceded, coalesce(wickets, 0) AS wickets, coalesce(innings, 0) AS innings, coalesce(first_season, 0) AS first_season, coalesce(last_season, 0) AS last_season
  FROM pl LEFT JOIN vv ON vv.player = pl.player)"""


def _volumes(s: SparkSession, d: str) -> DataFrame:
    return ag.volumes(lx(s, d), v.table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("player")), v.parts(s, d))


@query("A3_volumes", L(_VOLUMES + " SELECT * FROM vol"))
def volumes(s: SparkSession, d: str) -> DataFrame:
    return _volumes(s, d)


_SPELLS = """
, r AS (SELECT innings_id, season, batter AS player, batting_team AS team FROM x WHERE NOT super_over UNION ALL SELECT innings_id, season, non_striker, batting_team FROM x WHERE NOT super_over UNION ALL SELECT innings_id, season, bowler, bowling_team FROM x WHERE NOT super_over),
 sp AS (SELECT player, team, count(DISTINCT innings_id) AS innings, min(season) AS first_season, max(season) AS last_season FROM r GROUP BY ALL)"""


@query("A4_careers", E(_SPELLS + " SELECT * FROM sp"))
def careers(s: SparkSession, d: str) -> DataFrame:
    return ag.careers(ex(s, d))


@query("A5_J12_career_labels", E(_SPELLS + """
, f AS (SELECT player, CASE team WHEN 3 THEN 4 WHEN 7 THEN 8 ELSE team END AS team, sum(innings)::BIGINT AS innings, min(first_season) AS f, max(last_season) AS l FROM sp GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY l DESC, innings DESC, team) AS rn FROM f),
 p AS (WITH RECURSIVE w(player, rn, team, innings) AS (SELECT player, rn, team, innings FROM o WHERE rn = 1 UNION ALL SELECT o.player, o.rn, CASE WHEN o.innings > 2 * w.innings THEN o.team ELSE w.team END, CASE WHEN o.innings > 2 * w.innings THEN o.innings ELSE w.innings END FROM w JOIN o ON o.player = w.player AND o.rn = w.rn + 1)
  SELECT player, arg_max(team, rn) AS team FROM w GROUP BY player)
 SELECT p.player, p.team, CASE WHEN min(f) = max(l) THEN min(f)::VARCHAR ELSE concat(min(f), '-', max(l)) END AS years FROM p JOIN f ON f.player = p.player GROUP BY p.player, p.team"""))
def career_labels(s: SparkSession, d: str) -> DataFrame:
    return ag.career_labels(ag.careers(ex(s, d)), {3: 4, 7: 8})


_EDGES = ", e AS (SELECT batter, bowler, count(*) FILTER (legal) AS balls, coalesce(sum(runs_bat), 0)::BIGINT AS runs, count(*) FILTER (costs AND credited AND player_out = batter) AS outs, count(*) FILTER (outcome = 0) AS dots, count(*) FILTER (outcome = 4) AS fours, count(*) FILTER (outcome = 5) AS sixes FROM x WHERE NOT super_over {} GROUP BY batter, bowler)"


@query("A6_edges", L(_EDGES.format("") + " SELECT * FROM e"))
def edges(s: SparkSession, d: str) -> DataFrame:
    return ag.edges(lx(s, d))


_DEGREE = ", a AS (SELECT batter AS player, count(*) AS f FROM e GROUP BY 1), b AS (SELECT bowler AS player, count(*) AS g FROM e GROUP BY 1), g AS (SELECT coalesce(a.player, b.player) AS player, coalesce(f, 0) AS bowlers_faced, coalesce(g, 0) AS batters_bowled FROM a FULL JOIN b ON a.player = b.player)"


@query("A7_degrees", L(_EDGES.format("") + _DEGREE + " SELECT * FROM g"))
def degrees(s: SparkSession, d: str) -> DataFrame:
    return ag.degrees(ag.edges(lx(s, d)))


@query("A8_graph_stats", E(_EDGES.format("") + _DEGREE + """
, n AS (SELECT count(*) AS nodes FROM (SELECT player FROM bat UNION SELECT player FROM bowl) u)
 SELECT nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (nodes::DOUBLE * nodes), 9) AS density, (SELECT player FROM g ORDER BY bowlers_faced DESC, player LIMIT 1) AS top_batter, (SELECT player FROM g ORDER BY batters_bowled DESC, player LIMIT 1) AS top_bowler FROM n"""))
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    x = ex(s, d)
    return ag.graph_stats(ag.edges(x), e_bat(x).select("player").union(e_bowl(x).select("player")))


@query("K1_worst_matchups", E(_EDGES.format("") + " SELECT *, round(coalesce(100.0 * runs / nullif(balls, 0), 0), 6) AS strike_rate, round(runs::DOUBLE / nullif(outs, 0), 6) AS average FROM e WHERE batter = 1 AND balls >= 2 ORDER BY strike_rate DESC, bowler LIMIT 15"))
def worst(s: SparkSession, d: str) -> DataFrame:
    return ag.worst_matchups(ag.edges(ex(s, d)), 1, 2)


@query("K2_pick_top", L(_VOLUMES + " SELECT player, bowled, last_season FROM vol WHERE last_season >= 1999 AND bowled > 0 ORDER BY bowled DESC, player LIMIT 20"))
def pick_top(s: SparkSession, d: str) -> DataFrame:
    return ag.pick_top(_volumes(s, d), 1999, 20, "bowled").select("player", "bowled", "last_season")


_COUNTS = """
, j AS (SELECT x.*, hand, bowl_class, CASE WHEN over < 6 THEN 0 WHEN over < 15 THEN 1 ELSE 2 END AS p FROM x LEFT JOIN bat ON bat.player = batter LEFT JOIN bowl ON bowl.player = bowler WHERE NOT super_over),
 cc AS (SELECT p * 2 + (hand = 'LHB')::INT AS cell, bowler AS player, season, outcome, total FROM j WHERE hand IS NOT NULL UNION ALL SELECT 6 + p * 2 + (bowl_class IN ('OB', 'LB', 'SLA', 'SLW'))::INT, batter, season, outcome, total FROM j WHERE bowl_class IS NOT NULL),
 cnt AS (SELECT cell, player, season, outcome, count(*) AS n, sum(total)::BIGINT AS runs FROM cc GROUP BY ALL)"""
_STATS = """
, grid AS (SELECT c.i::INT AS cell, o.i::INT AS outcome, [0, 1, 2, 3, 4, 6, 0, 1, 1][o.i + 1]::DOUBLE AS nominal FROM range(12) c(i), range(9) o(i)),
 st AS (SELECT g.cell, g.outcome, coalesce(a.n, 0) AS n, coalesce(w.players, 0) AS players, coalesce(w.deliveries, 0) AS deliveries, coalesce(coalesce(a.n, 0)::DOUBLE / w.deliveries, 1 / 9::DOUBLE) AS prior, coalesce(a.runs::DOUBLE / a.n, nominal) AS mean_runs
  FROM grid g LEFT JOIN (SELECT cell, outcome, sum(n)::BIGINT AS n, sum(runs)::BIGINT AS runs FROM cnt GROUP BY ALL) a ON a.cell = g.cell AND a.outcome = g.outcome
  LEFT JOIN (SELECT cell, count(DISTINCT player) AS players, sum(n)::BIGINT AS deliveries FROM cnt GROUP BY ALL) w ON w.cell = g.cell)"""
_POST = """
, pls AS (SELECT player FROM bowl UNION SELECT player FROM bat), own AS (SELECT cell, player, outcome, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL), tot AS (SELECT cell, player, sum(n)::BIGINT AS total FROM own GROUP BY ALL),
 post AS (SELECT st.cell, p.player, st.outcome, coalesce(own.n, 0) AS n, coalesce(tot.total, 0) AS total, (coalesce(own.n, 0) + 150.0::DOUBLE * prior) / (coalesce(tot.total, 0) + 150.0::DOUBLE) AS posterior, coalesce(tot.total, 0) / (coalesce(tot.total, 0) + 150.0::DOUBLE) AS weight, mean_runs, prior
  FROM pls p CROSS JOIN st LEFT JOIN own ON own.cell = st.cell AND own.player = p.player AND own.outcome = st.outcome LEFT JOIN tot ON tot.cell = st.cell AND tot.player = p.player)"""


def _counts(s: SparkSession, d: str) -> DataFrame:
    return ra.cell_counts(lx(s, d), v.batting_attributes(s, d), v.bowling_attributes(s, d), v.parts(s, d))


def _kappa(s: SparkSession, k: float = 150.0) -> DataFrame:
    return s.range(12).select(F.col("id").cast("int").alias("cell"), F.lit(k).alias("kappa"))


def _phase_rates(s: SparkSession, d: str) -> DataFrame:
    n = v.parts(s, d)
    players = written(ra.player_counts(lx(s, d), v.batting_attributes(s, d), v.bowling_attributes(s, d), n), "players")
    return ra.phase_rates(players, ra.stats_of_players(players), _kappa(s), n)


def _post(s: SparkSession, d: str) -> DataFrame:
    c = _counts(s, d)
    players = v.bowling_attributes(s, d).select("player").union(v.batting_attributes(s, d).select("player")).distinct()
    return ra.posteriors(c, ra.cell_stats(c), players, _kappa(s))


@query("A9_cell_counts", L(_COUNTS + " SELECT * FROM cnt"))
def cell_counts(s: SparkSession, d: str) -> DataFrame:
    return _counts(s, d)


@query("A10_B1_cell_stats", L(_COUNTS + _STATS + " SELECT cell, outcome, n, players, deliveries, round(prior, 9) AS prior, round(mean_runs, 6) AS mean_runs FROM st"))
def cell_stats(s: SparkSession, d: str) -> DataFrame:
    return ra.cell_stats(_counts(s, d)).withColumn("prior", F.round("prior", 9)).withColumn("mean_runs", F.round("mean_runs", 6))


@query("B2_B3_B6_posteriors", L(_COUNTS + _STATS + _POST + " SELECT cell, player, outcome, n, total, round(posterior, 6) AS posterior, round(weight, 6) AS weight FROM post"))
def posteriors(s: SparkSession, d: str) -> DataFrame:
    return _post(s, d).select("cell", "player", "outcome", "n", "total", F.round("posterior", 6).alias("posterior"), F.round("weight", 6).alias("weight"))


@query("B7_cell_rates", L(_COUNTS + _STATS + _POST + """
, g AS (SELECT cell, player, max(total) AS total, max(weight) AS weight, sum(posterior * mean_runs) AS xr, sum(posterior) FILTER (outcome = 7) AS wd, sum(posterior) FILTER (outcome = 8) AS nb, sum(posterior) FILTER (outcome = 6) AS w FROM post GROUP BY ALL)
 SELECT cell, player, total, round(weight, 6) AS weight, round(xr, 6) AS expected_runs, round(1 - wd - nb, 6) AS legal_share, round(coalesce(6 * xr / nullif(1 - wd - nb, 0), 0), 6) AS economy, round(coalesce(100 * xr / nullif(1 - wd - nb, 0), 0), 6) AS strike_rate, round(coalesce((1 - wd - nb) / nullif(w, 0), 0), 6) AS balls_per_wicket FROM g"""))
def cell_rates(s: SparkSession, d: str) -> DataFrame:
    return ra.cell_rates(_post(s, d))


_PHASE = """
, c AS (SELECT player, (cell // 6)::INT AS role, (cell // 2 % 3)::INT AS phase, cell, max(total) AS total, max(weight) AS weight, sum(posterior * mean_runs) AS xr, sum(n::DOUBLE / total * mean_runs) AS rr, sum(posterior) FILTER (outcome IN (7, 8)) AS xi, sum(n::DOUBLE / total) FILTER (outcome IN (7, 8)) AS ri FROM post WHERE total > 0 GROUP BY ALL),
 h AS (SELECT player, role, phase, sum(total)::BIGINT AS deliveries, sum(weight * total) / sum(total) AS weight, sum(xr * total) / sum(total) AS xr, sum(rr * total) / sum(total) AS rr, sum(xi * total) / sum(total) AS xi, sum(ri * total) / sum(total) AS ri FROM c GROUP BY ALL),
 pr AS (SELECT player, role, phase, deliveries, round(weight, 6) AS weight, round(coalesce(6 * rr / nullif(1 - ri, 0), 0), 6) AS raw_rate, round(coalesce(6 * xr / nullif(1 - xi, 0), 0), 6) AS shrunk_rate FROM h)"""


@query("A21_phase_rates", L(_COUNTS + _STATS + _POST + _PHASE + " SELECT * FROM pr"))
def phase_rates(s: SparkSession, d: str) -> DataFrame:
    return _phase_rates(s, d)


@query("K3_leaderboard", L(_COUNTS + _STATS + _POST + _PHASE + " SELECT *, row_number() OVER (PARTITION BY role, phase ORDER BY CASE role WHEN 0 THEN shrunk_rate ELSE -shrunk_rate END, player) AS place FROM pr WHERE deliveries >= 20 QUALIFY place <= 15"))
def leaderboard(s: SparkSession, d: str) -> DataFrame:
    return ra.leaderboard(_phase_rates(s, d), 20)


@query("K4_movers", L(_COUNTS + _STATS + _POST + _PHASE + " SELECT *, round(shrunk_rate - raw_rate, 6) AS moved FROM pr WHERE role = 0 AND deliveries >= 30 AND raw_rate <> 0 ORDER BY moved DESC, player, phase LIMIT 20"))
def movers(s: SparkSession, d: str) -> DataFrame:
    return ra.movers(_phase_rates(s, d))


@query("B4_log_marginal", L(_COUNTS + _STATS + """
, own AS (SELECT cell, player, outcome, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL), t AS (SELECT cell, player, sum(n)::BIGINT AS n FROM own GROUP BY ALL),
 a AS (SELECT cell, sum(lgamma(150.0::DOUBLE) - lgamma(n + 150.0::DOUBLE)) AS v FROM t GROUP BY cell), b AS (SELECT own.cell, sum(lgamma(own.n + 150.0::DOUBLE * prior) - lgamma(150.0::DOUBLE * prior)) AS v FROM own JOIN st ON st.cell = own.cell AND st.outcome = own.outcome WHERE prior > 0 GROUP BY own.cell)
 SELECT a.cell, round(a.v + b.v, 3) AS log_marginal FROM a JOIN b ON a.cell = b.cell"""))
def log_marginal(s: SparkSession, d: str) -> DataFrame:
    c = _counts(s, d)
    return ra.log_marginal(ra.count_sizes(c), ra.cell_stats(c), _kappa(s)).select("cell", F.round("log_marginal", 3).alias("log_marginal"))


def _concentration_sql() -> str:
    """The slope as sums of 1 / (a + j), on the same grids."""
    lo, hi = 0.0, 6 * 2.302585092994046
    sql = _COUNTS + _STATS + f"""
, own AS (SELECT cell, player, outcome, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL), tot AS (SELECT cell, player, -1 AS outcome, sum(n)::BIGINT AS n FROM own GROUP BY ALL), kn AS (SELECT cell, count(DISTINCT player) AS players FROM own GROUP BY cell),
 tail AS MATERIALIZED (SELECT o.cell, o.outcome, u.j, count(*) AS above, any_value(CASE WHEN o.outcome = -1 THEN 1.0::DOUBLE ELSE prior END) AS share FROM (SELECT * FROM own UNION ALL SELECT * FROM tot) o LEFT JOIN st ON st.cell = o.cell AND st.outcome = o.outcome, unnest(range(0, o.n)) AS u(j) GROUP BY ALL),
 b0 AS (SELECT cell, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM kn WHERE players >= 2)"""
    for k in range(5):
        sql += f""",
 g{k} AS (SELECT cell, i, lo + (hi - lo) * i / 32 AS t FROM b{k}, range(33) r(i)), s{k} AS (SELECT g.cell, g.i, sum(CASE WHEN outcome = -1 THEN -above ELSE above END * share / (exp(t) * share + j)) AS slope FROM g{k} g JOIN tail ON tail.cell = g.cell WHERE share > 0 GROUP BY ALL),
 f{k} AS (SELECT b.cell, coalesce(min(i) FILTER (slope <= 0), 33) AS f FROM b{k} b JOIN s{k} s ON s.cell = b.cell GROUP BY b.cell), b{k + 1} AS MATERIALIZED (SELECT f.cell, (SELECT t FROM g{k} g WHERE g.cell = f.cell AND g.i = greatest(0, f - 1)) AS lo, (SELECT t FROM g{k} g WHERE g.cell = f.cell AND g.i = least(32, f)) AS hi FROM f{k} f)"""
    return sql + " SELECT kn.cell, round(coalesce(exp((lo + hi) / 2), 1e6), 3) AS kappa FROM kn LEFT JOIN b5 ON b5.cell = kn.cell"


@query("B5_F19_concentration", L(_concentration_sql()))
def concentration(s: SparkSession, d: str) -> DataFrame:
    c = _counts(s, d)
    return ra.fit_concentration(c, ra.cell_stats(c)).withColumn("kappa", F.round("kappa", 3))


_QUALITY = """
, bq AS (SELECT player, sum(w * greatest(0.0, least(1.0, (11 - shrunk_rate) / 3.5))) / sum(w) AS q FROM (SELECT *, CASE phase WHEN 2 THEN 0.5::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w FROM pr WHERE role = 0) z GROUP BY player)"""


@query("B8_bowler_quality", L(_COUNTS + _STATS + _POST + _PHASE + _QUALITY + " SELECT player, round(q, 6) AS quality, greatest(3, least(20, floor(3 + 17 * q + 0.5)::INT)) AS cost FROM bq"))
def quality(s: SparkSession, d: str) -> DataFrame:
    return ra.bowler_quality(_phase_rates(s, d))


_BATTERS = """
, sr AS (SELECT player, sum(w * shrunk_rate * 100 / 6) / sum(w) AS sr FROM (SELECT *, CASE phase WHEN 2 THEN 0.4::DOUBLE WHEN 1 THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END AS w FROM pr WHERE role = 1) z GROUP BY player),
 bb AS (SELECT sr.player, 0.7::DOUBLE * greatest(0.0, least(1.0, (sr - 110) / 55)) + 0.3::DOUBLE * CASE WHEN dismissals = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (faced::DOUBLE / dismissals - 12) / 18)) END AS q FROM sr JOIN vol ON vol.player = sr.player)"""


@query("B8_batter_quality", L(_VOLUMES + _COUNTS + _STATS + _POST + _PHASE + _BATTERS + """
 SELECT player, round(q, 6) AS quality, greatest(3, least(20, floor(3 + 17 * q + 0.5)::INT)) AS cost FROM bb"""))
def batter_quality(s: SparkSession, d: str) -> DataFrame:
    return ra.batter_quality(_phase_rates(s, d), _volumes(s, d))


@query("B9_K8_draft_pool", L(_VOLUMES + _COUNTS + _STATS + _POST + _PHASE + _QUALITY + _BATTERS + """
, pool AS (SELECT 'bowler' AS role, bq.player, q FROM bq JOIN vol ON vol.player = bq.player WHERE bowled >= 400 AND round(q, 6) > 0
 UNION ALL SELECT 'batter', bb.player, q FROM bb JOIN vol ON vol.player = bb.player WHERE faced >= 500 AND faced >= 11 * innings AND round(q, 6) >= 0.2)
 SELECT role, player, round(q, 6) AS quality, greatest(3, least(20, floor(3 + 17 * q + 0.5)::INT)) AS cost FROM pool ORDER BY role DESC, cost DESC, player"""))
def draft(s: SparkSession, d: str) -> DataFrame:
    # both roles read rates and volumes, which are made once
    r, vol = written(_phase_rates(s, d), "rates"), written(_volumes(s, d).select("player", "faced", "dismissals", "bowled", "innings"), "volumes")
    if n := v.parts(s, d):
        r, vol = r.repartition(n, "player"), vol.repartition(n, "player")
    return ra.draft_pool(ra.bowler_quality(r), ra.batter_quality(r, vol), vol).orderBy(F.desc("role"), F.desc("cost"), "player")


@query("A11_venue_rates", L("""
, g AS (SELECT venue, coalesce(sum(total), 0)::BIGINT AS total, count(*) FILTER (legal) AS legal FROM x WHERE season <= 1999 GROUP BY venue)
 SELECT venue, legal, round(CASE WHEN legal >= 1300 THEN total::DOUBLE / legal ELSE (SELECT sum(total)::DOUBLE / sum(legal) FROM g) END, 6) AS run_rate FROM g"""))
def venues(s: SparkSession, d: str) -> DataFrame:
    return ag.venue_rates(lx(s, d), 1300, 1999)


@query("A12_coverage", "SELECT round(avg(CASE WHEN coalesce(lang, '') <> '' THEN 100.0 ELSE 0 END), 6) AS lang, round(avg(CASE WHEN coalesce(source, '') <> '' THEN 100.0 ELSE 0 END), 6) AS source, round(avg(CASE WHEN coalesce(text, '') <> '' THEN 100.0 ELSE 0 END), 6) AS text FROM documents")
def coverage(s: SparkSession, d: str) -> DataFrame:
    from seamline.sources.ingest import coverage as share

    return share(v.table(s, d, "documents"), "lang", "source", "text")


@query("A13_counters", L(" SELECT phase, season, count(*) AS deliveries, count(*) FILTER (legal) AS legal, coalesce(sum(extras), 0)::BIGINT AS extras, count(*) FILTER (wicket IS NOT NULL) AS wickets FROM x GROUP BY GROUPING SETS ((phase), (season), ())"))
def counters(s: SparkSession, d: str) -> DataFrame:
    return ag.counters(lx(s, d))


_SIGHT = "SELECT 'n' || (p_partkey % 97)::VARCHAR || p_type AS name, p_size AS id FROM part"


def _sightings(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "part").selectExpr("concat('n', cast(p_partkey % 97 as string), p_type) AS name", "p_size AS id")


@query("A14_name_multiplicity", f"""
WITH t AS ({_SIGHT}) SELECT 'name' AS kind, name AS value, count(DISTINCT id) AS n, array_to_string(list_sort(list(DISTINCT id::VARCHAR)), ',') AS others FROM t GROUP BY name HAVING count(DISTINCT id) >= 2
UNION ALL SELECT 'id', id::VARCHAR, count(DISTINCT name), array_to_string(list_sort(list(DISTINCT name)), ',') FROM t GROUP BY id HAVING count(DISTINCT name) >= 2""")
def multiplicity(s: SparkSession, d: str) -> DataFrame:
    return ag.name_multiplicity(_sightings(s, d))


@query("A15_J5_preferred_names", f"WITH t AS ({_SIGHT}), g AS (SELECT id, name, count(*) AS n FROM t GROUP BY ALL) SELECT id, name, n FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, length(name) DESC, name) = 1")
def preferred(s: SparkSession, d: str) -> DataFrame:
    return ag.preferred_names(_sightings(s, d))


_ELIGIBLE = ", el AS (SELECT *, bowled >= 40 AND last_season >= 1996 AS as_bowler, faced >= 40 AND last_season >= 1996 AS as_batter FROM vol), el2 AS (SELECT * FROM el WHERE as_bowler OR as_batter)"


def _eligible(s: SparkSession, d: str) -> DataFrame:
    return ag.eligible(_volumes(s, d), 40, 40, 1996)


@query("U1_eligible", L(_VOLUMES + _ELIGIBLE + " SELECT player, as_bowler, as_batter FROM el2"))
def eligible(s: SparkSession, d: str) -> DataFrame:
    return _eligible(s, d).select("player", "as_bowler", "as_batter")


_DEAL = """
, dl AS (SELECT el2.*, hand, bowl_class, as_bowler AND bowl_class IS NOT NULL AND hand IS NOT NULL AS deal_bowler, as_batter AND hand IS NOT NULL AS deal_batter FROM el2 LEFT JOIN bat ON bat.player = el2.player LEFT JOIN bowl ON bowl.player = el2.player)"""


@query("U2_U3_K6_dealable", L(_VOLUMES + _ELIGIBLE + _DEAL + " SELECT player, deal_bowler, deal_batter, NOT (deal_bowler OR deal_batter) AS excluded, CASE WHEN NOT (deal_bowler OR deal_batter) THEN concat_ws(', ', CASE WHEN hand IS NULL THEN 'hand unknown' END, CASE WHEN bowled >= 40 AND bowl_class IS NULL THEN 'class unknown' END) END AS reason, bowled FROM dl ORDER BY bowled DESC, player"))
def dealable(s: SparkSession, d: str) -> DataFrame:
    return ag.dealable(_eligible(s, d), v.batting_attributes(s, d), v.bowling_attributes(s, d), 40).select("player", "deal_bowler", "deal_batter", "excluded", "reason", "bowled").orderBy(F.desc("bowled"), "player")


@query("U4_A16_review_and_coverage", L(_VOLUMES + _ELIGIBLE + """
 SELECT 'bowler' AS role, coalesce(bowl_class, 'unknown') AS value, count(*) AS n FROM el2 LEFT JOIN bowl ON bowl.player = el2.player WHERE as_bowler GROUP BY ALL
 UNION ALL SELECT 'batter', coalesce(hand, 'unknown'), count(*) FROM el2 LEFT JOIN bat ON bat.player = el2.player WHERE as_batter GROUP BY ALL"""))
def review(s: SparkSession, d: str) -> DataFrame:
    e = _eligible(s, d)
    a = e.where("as_bowler").join(v.bowling_attributes(s, d), "player", "left").select(F.lit("bowler").alias("role"), F.coalesce("bowl_class", F.lit("unknown")).alias("value"))
    b = e.where("as_batter").join(v.batting_attributes(s, d), "player", "left").select(F.lit("batter").alias("role"), F.coalesce("hand", F.lit("unknown")).alias("value"))
    return a.union(b).groupBy("role", "value").agg(F.count("*").alias("n"))


@query("A17_signature", E("""
, g AS (SELECT bowler, count(*) FILTER (legal) AS legal, count(*) FILTER (legal AND phase = 'powerplay') AS pp, count(*) FILTER (legal AND phase = 'middle') AS mid, count(*) FILTER (legal AND phase = 'death') AS death, count(*) FILTER (wicket = 'stumped') AS st, coalesce(sum(noballs), 0)::BIGINT AS nb FROM x WHERE NOT super_over GROUP BY bowler HAVING count(*) FILTER (legal) > 0),
 h AS (SELECT *, CASE WHEN st >= 3 THEN 2.0::DOUBLE WHEN st >= 1 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END + 2 * (mid / legal::DOUBLE - 0.5::DOUBLE) - 2 * (pp / legal::DOUBLE + death / legal::DOUBLE - 0.5::DOUBLE) - 20 * (nb / legal::DOUBLE) AS score FROM g)
 SELECT bowler, legal, round(pp / legal::DOUBLE, 6) AS pp_share, round(mid / legal::DOUBLE, 6) AS mid_share, round(death / legal::DOUBLE, 6) AS death_share, round(score, 6) AS score, CASE WHEN score > 0 THEN 'spin' ELSE 'pace' END AS guess, round(least(abs(score) / 2.5::DOUBLE, 0.95::DOUBLE) * CASE WHEN legal < 300 THEN legal / 300.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS confidence FROM h"""))
def signature(s: SparkSession, d: str) -> DataFrame:
    return ag.bowling_signature(ex(s, d))


@query("A18_day_stats", E("""
 SELECT count(*) AS runs, round(coalesce(avg(defended::DOUBLE), 0), 6) AS defended, round(coalesce(avg(chased::DOUBLE), 0), 6) AS chased, round(coalesce(avg((defended = 1 AND chased = 1)::INT::DOUBLE), 0), 6) AS both, round(coalesce(avg((defended = 0 AND chased = 0)::INT::DOUBLE), 0), 6) AS neither, round(coalesce(avg(total_score), 0), 6) AS mean_score FROM runs WHERE date = '2024-01-10'"""))
def day(s: SparkSession, d: str) -> DataFrame:
    return re_.day_stats(v.results(s, d), "2024-01-10")


@query("A19_percentile", E(" SELECT round(coalesce(100.0 * count(*) FILTER (total_score < 120) / nullif(count(*), 0), 0), 6) AS percentile FROM runs WHERE date = '2024-01-10'"))
def percentile(s: SparkSession, d: str) -> DataFrame:
    return re_.percentile(v.results(s, d), "2024-01-10", 120.0)


@query("K5_daily_leaderboard", E(" SELECT id, player, defended = 1 AND chased = 1 AS solved, total_score FROM runs WHERE date = '2024-01-10' AND trim(player) <> '' ORDER BY solved DESC, total_score DESC, id LIMIT 20"))
def daily(s: SparkSession, d: str) -> DataFrame:
    return re_.daily_leaderboard(v.results(s, d), "2024-01-10", 20)


@query("A22_A23_venues", E(" SELECT venue, max(season) AS last_season, count(*) FILTER (legal) AS legal, max(season) >= 2022 AS recent, count(*) FILTER (legal) >= 600 AS busy FROM x GROUP BY venue"))
def last_seen(s: SparkSession, d: str) -> DataFrame:
    g = ex(s, d).groupBy("venue").agg(F.max("season").alias("last_season"), F.count_if("legal").alias("legal"))
    return g.withColumn("recent", F.col("last_season") >= 2022).withColumn("busy", F.col("legal") >= 600)


_STATE = """
, w AS (SELECT *, coalesce(sum(total) OVER i, 0)::BIGINT AS score_before, coalesce(sum(costs::INT) OVER i, 0)::BIGINT AS wickets_before, coalesce(sum(legal::INT) OVER i, 0)::BIGINT AS legal_before,
  coalesce(sum(legal::INT) OVER (PARTITION BY innings_id, over ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS legal_ball, coalesce(sum(legal::INT) OVER (PARTITION BY innings_id, batter ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS striker_balls
  FROM x {} WINDOW i AS (PARTITION BY innings_id ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, coalesce(sum(total) OVER t, 0)::BIGINT AS stand_runs, coalesce(sum(legal::INT) OVER t, 0)::BIGINT AS stand_balls FROM w WINDOW t AS (PARTITION BY innings_id, wickets_before ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_STATE_COLS = ["delivery_id", "score_before", "wickets_before", "legal_before", "legal_ball", "striker_balls", "stand_runs", "stand_balls"]


@query("W1_W2_W4_W5_running_state", E(_STATE.format("") + f" SELECT {', '.join(_STATE_COLS)} FROM s"))
def state(s: SparkSession, d: str) -> DataFrame:
    return wi.running_state(ex(s, d)).select(_STATE_COLS)


@query("W3_F8_index_check", E(_STATE.format("") + ", l AS (SELECT delivery_id, over, legal_ball, CASE WHEN delivery_id % 50 = 0 THEN over + 1 ELSE over END AS lo, legal_ball AS ln, delivery_id % 100 = 0 AS miscounted FROM s) SELECT delivery_id, concat(lo, '.', ln + 1) AS label, count(*) OVER () AS mismatches FROM l WHERE (lo <> over OR ln <> legal_ball) AND NOT miscounted ORDER BY delivery_id LIMIT 20"))
def index_check(s: SparkSession, d: str) -> DataFrame:
    x = wi.running_state(ex(s, d)).withColumn("label", F.expr("concat(cast(CASE WHEN delivery_id % 50 = 0 THEN over + 1 ELSE over END as string), '.', cast(legal_ball + 1 as string))")).withColumn("miscounted", F.expr("delivery_id % 100 = 0"))
    return wi.index_check(x).select("delivery_id", "label", "mismatches")


_POSITIONS = """
, a AS (SELECT innings_id, batter AS player, delivery_id * 2 AS seen FROM x WHERE NOT super_over UNION ALL SELECT innings_id, non_striker, delivery_id * 2 + 1 FROM x WHERE NOT super_over), f AS (SELECT innings_id, player, min(seen) AS seen FROM a GROUP BY ALL),
 pp AS (SELECT player, row_number() OVER (PARTITION BY innings_id ORDER BY seen, player) AS place FROM f), pos AS (SELECT player, round(sum(place)::DOUBLE / count(*), 6) AS mean_position, count(*) AS innings FROM pp GROUP BY player)"""


@query("W6_batting_positions", E(_POSITIONS + " SELECT * FROM pos"))
def positions(s: SparkSession, d: str) -> DataFrame:
    return wi.batting_positions(ex(s, d))


@query("W7_batting_order", E(_POSITIONS + ", k AS (SELECT player, CASE WHEN innings >= 40 THEN mean_position ELSE 6.0::DOUBLE END AS key FROM pos) SELECT player, key, row_number() OVER (ORDER BY key, player) AS place FROM k"))
def order(s: SparkSession, d: str) -> DataFrame:
    return wi.batting_order(wi.batting_positions(ex(s, d)), 40)


@query("W8_streaks", E("""
, dd AS (SELECT DISTINCT player, date::DATE AS day FROM runs WHERE date <= '2024-01-20' AND trim(player) <> ''), i AS (SELECT player, day, day - row_number() OVER (PARTITION BY player ORDER BY day)::INT AS island FROM dd),
 n AS (SELECT player, island, max(day) AS last, count(*) AS n FROM i GROUP BY ALL) SELECT player, max(CASE WHEN last = DATE '2024-01-20' THEN n ELSE 0 END) AS streak FROM n GROUP BY player"""))
def streaks(s: SparkSession, d: str) -> DataFrame:
    return wi.streaks(v.results(s, d), "2024-01-20")


@query("W9_contiguity", E(", r AS (SELECT innings_id, min(delivery_id) AS lo, max(delivery_id) AS hi, count(*) AS n FROM x GROUP BY innings_id), g AS (SELECT *, lo - lag(hi) OVER (ORDER BY lo) - 1 AS gap FROM r) SELECT *, coalesce(gap, 0) <> 0 OR hi - lo + 1 <> n AS fault FROM g"))
def contiguity(s: SparkSession, d: str) -> DataFrame:
    return wi.placed_innings(ex(s, d))


_POOL = "SELECT s_suppkey::BIGINT AS player, s_acctbal AS economy, s_nationkey % 7 IN (3, 4, 5, 6) AS is_spin FROM supplier"


def _pool(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "supplier").selectExpr("cast(s_suppkey as bigint) AS player", "s_acctbal AS economy", "s_nationkey % 7 IN (3, 4, 5, 6) AS is_spin")


@query("W11_terciles", f"WITH p AS ({_POOL}), r AS (SELECT *, row_number() OVER (ORDER BY economy, player) - 1 AS r, count(*) OVER () // 3 AS t FROM p) SELECT player, economy, is_spin, CASE WHEN r < t THEN 0 WHEN r < 2 * t THEN 1 ELSE 2 END AS tier FROM r")
def terciles(s: SparkSession, d: str) -> DataFrame:
    return wi.terciles(_pool(s, d), "economy")


@query("W12_even_sample", f"WITH p AS ({_POOL}), r AS (SELECT *, row_number() OVER (ORDER BY economy, player) - 1 AS r FROM p) SELECT player, economy, is_spin FROM r WHERE r IN (SELECT i * ((SELECT count(*) FROM p) - 1) // 6 FROM range(7) t(i))")
def even(s: SparkSession, d: str) -> DataFrame:
    return wi.even_sample(_pool(s, d), "economy", 7)


@query("M25_group_spread", f"WITH p AS ({_POOL}), r AS (SELECT *, row_number() OVER (PARTITION BY is_spin ORDER BY economy, player) AS g FROM p) SELECT player, economy, is_spin FROM r ORDER BY CASE WHEN g <= 2 THEN 0 ELSE 1 END, economy, player LIMIT 6")
def group_spread(s: SparkSession, d: str) -> DataFrame:
    return wi.per_group_then_fill(_pool(s, d), "is_spin", "economy", 6)


_HEAD = """
, m AS (SELECT batter, bowler, match_id, count(*) FILTER (legal) AS balls, sum(runs_bat)::BIGINT AS runs, count(*) FILTER (costs AND credited AND player_out = batter) AS outs FROM x WHERE NOT super_over GROUP BY ALL),
 hh AS (SELECT batter, bowler, match_id, coalesce(sum(balls) OVER w, 0)::BIGINT AS h_balls, coalesce(sum(runs) OVER w, 0)::BIGINT AS h_runs, coalesce(sum(outs) OVER w, 0)::BIGINT AS h_outs FROM m WINDOW w AS (PARTITION BY batter, bowler ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("J6_head_to_head", E(_HEAD + " SELECT * FROM hh"))
def head(s: SparkSession, d: str) -> DataFrame:
    return ft.head_to_head_before(ex(s, d))


_SEASON = """
, ss AS (SELECT DISTINCT season AS s FROM cnt), so AS (SELECT s, cell, player, outcome, sum(n)::BIGINT AS n FROM cnt JOIN ss ON season < s GROUP BY ALL), sc AS (SELECT s, cell, outcome, sum(n) AS cn FROM so GROUP BY ALL), sp2 AS (SELECT *, cn / sum(cn) OVER (PARTITION BY s, cell)::DOUBLE AS prior FROM sc), sw AS (SELECT s, cell, player, sum(n)::BIGINT AS total FROM so GROUP BY ALL),
 sr AS (SELECT sw.s AS season, sw.cell, sw.player, sp2.outcome, (coalesce(so.n, 0) + 150.0::DOUBLE * prior) / (total + 150.0::DOUBLE) AS posterior, total / (total + 150.0::DOUBLE) AS weight FROM sw JOIN sp2 ON sp2.s = sw.s AND sp2.cell = sw.cell LEFT JOIN so ON so.s = sw.s AND so.cell = sw.cell AND so.player = sw.player AND so.outcome = sp2.outcome)"""


@query("J7_season_rates", E(_COUNTS + _SEASON + " SELECT season, cell, player, outcome, round(posterior, 6) AS posterior, round(weight, 6) AS weight FROM sr"))
def season_rates(s: SparkSession, d: str) -> DataFrame:
    x = ex(s, d)
    r = ft.season_rates_before(ra.cell_counts(x, e_bat(x), e_bowl(x)), 150.0)
    return r.withColumn("posterior", F.round("posterior", 6)).withColumn("weight", F.round("weight", 6))


_NOMINAL = "[0, 1, 2, 3, 4, 6, 0, 1, 1][outcome + 1]::DOUBLE"
_FEATURES = _HEAD + _COUNTS + _SEASON + _STATE.format("WHERE NOT super_over") + f"""
, ps AS (SELECT season, cell, player, sum(posterior * {_NOMINAL}) AS exp_runs, sum(posterior) FILTER (outcome = 0) AS dot, coalesce(sum(posterior) FILTER (outcome IN (4, 5)), 0) AS boundary, coalesce(sum(posterior) FILTER (outcome = 6), 0) AS wicket FROM sr GROUP BY ALL),
 ti AS (SELECT match_id, innings_id, sum(total)::BIGINT AS runs FROM x WHERE NOT super_over GROUP BY ALL), tg AS (SELECT innings_id, runs, coalesce(lag(runs) OVER (PARTITION BY match_id ORDER BY innings_id) + 1, 0) AS target FROM ti),
 ve AS (SELECT season, venue, sum(total)::BIGINT AS t, count(*) FILTER (legal) AS l FROM x GROUP BY ALL), vg AS (SELECT a.season, b.venue FROM (SELECT DISTINCT season FROM ve) a, (SELECT DISTINCT venue FROM ve) b),
 vo AS (SELECT vg.season, vg.venue, coalesce(sum(t), 0)::BIGINT AS t, coalesce(sum(l), 0)::BIGINT AS l FROM vg LEFT JOIN ve ON ve.venue = vg.venue AND ve.season < vg.season GROUP BY ALL),
 vr AS (SELECT season, venue, CASE WHEN l >= 600 THEN t::DOUBLE / l ELSE coalesce(sum(t) OVER (PARTITION BY season)::DOUBLE / nullif(sum(l) OVER (PARTITION BY season), 0), 0) END AS venue_rate FROM vo),
 fe AS (SELECT s.*, hand, bowl_class, target, coalesce(venue_rate, 0) AS venue_rate, coalesce(h_balls, 0) AS h_balls, coalesce(h_runs, 0) AS h_runs, coalesce(h_outs, 0) AS h_outs, greatest(0, 120 - legal_before) AS balls_remaining, CASE WHEN target > 0 THEN greatest(0, target - score_before) ELSE 0 END AS need,
   CASE WHEN over < 6 THEN 0 WHEN over < 15 THEN 1 ELSE 2 END AS ph FROM s JOIN tg ON tg.innings_id = s.innings_id JOIN bat ON bat.player = batter JOIN bowl ON bowl.player = bowler LEFT JOIN hh ON hh.batter = s.batter AND hh.bowler = s.bowler AND hh.match_id = s.match_id LEFT JOIN vr ON vr.season = s.season AND vr.venue = s.venue WHERE hand IS NOT NULL AND bowl_class IS NOT NULL),
 fx AS (SELECT fe.*, coalesce(a.exp_runs, 0) AS a_x, coalesce(a.dot, 0) AS a_d, coalesce(a.boundary, 0) AS a_b, coalesce(a.wicket, 0) AS a_w, coalesce(b.exp_runs, 0) AS b_x, coalesce(b.wicket, 0) AS b_w FROM fe LEFT JOIN ps a ON a.season = fe.season AND a.player = batter AND a.cell = 6 + ph * 2 + (bowl_class IN ('OB', 'LB', 'SLA', 'SLW'))::INT LEFT JOIN ps b ON b.season = fe.season AND b.player = bowler AND b.cell = ph * 2 + (hand = 'LHB')::INT)"""
_FEATURE_SQL = {
    "innings": "CASE WHEN target > 0 THEN 2 ELSE 1 END", "over": "over", "legal_ball": "legal_ball", "balls_remaining": "balls_remaining", "score": "score_before", "wickets": "wickets_before", "crr": "coalesce(6.0 * score_before / nullif(legal_before, 0), 0)", "target": "target", "required_runs": "need",
    "required_rate": "CASE WHEN target > 0 THEN coalesce(6.0 * need / nullif(balls_remaining, 0), 0) ELSE 0 END", "striker_balls": "striker_balls", "new_batter": "(striker_balls < 6)::INT", "stand_runs": "stand_runs", "stand_balls": "stand_balls", "is_powerplay": "(over < 6)::INT", "is_death": "(over >= 15)::INT",
    "striker_lhb": "(hand = 'LHB')::INT", "bowler_spin": "(bowl_class IN ('OB', 'LB', 'SLA', 'SLW'))::INT", "moves_away": "((hand = 'RHB' AND bowl_class IN ('LB', 'SLA', 'LAP')) OR (hand = 'LHB' AND bowl_class IN ('OB', 'SLW', 'RAP')))::INT", "venue_rate": "venue_rate", "h_balls": "h_balls",
    "h_strike_rate": "coalesce(100.0 * h_runs / nullif(h_balls, 0), 0)", "h_out_rate": "coalesce(h_outs::DOUBLE / nullif(h_balls, 0), 0)", "bat_exp_runs": "a_x", "bat_dot": "a_d", "bat_boundary": "a_b", "bat_wicket": "a_w", "bowl_exp_runs": "b_x", "bowl_economy": "6 * b_x", "bowl_wicket": "b_w",
}


@query("E1_E2_features", E(_FEATURES + f" SELECT delivery_id, match_id, season, outcome AS label, {', '.join(f'round(({q})::DOUBLE, 6) AS {c}' for c, q in _FEATURE_SQL.items())} FROM fx"))
def features(s: SparkSession, d: str) -> DataFrame:
    x = ex(s, d)
    return ft.extract(x, e_bat(x), e_bowl(x)).withColumns({c: F.round(c, 6) for c in ft.FEATURES})


@query("E3_S12_win_matrix", E(_STATE.format("WHERE NOT super_over") + """
, ti AS (SELECT match_id, innings_id, sum(total)::BIGINT AS runs FROM x WHERE NOT super_over GROUP BY ALL), tg AS (SELECT innings_id, runs, lag(runs) OVER (PARTITION BY match_id ORDER BY innings_id) + 1 AS target FROM ti),
 ve AS (SELECT venue, sum(total)::BIGINT AS t, count(*) FILTER (legal) AS l FROM x WHERE season <= 2022 GROUP BY venue), vr AS (SELECT venue, round(CASE WHEN l >= 600 THEN t::DOUBLE / l ELSE (SELECT sum(t)::DOUBLE / sum(l) FROM ve) END, 6) AS r FROM ve)
 SELECT delivery_id, season, (target - score_before)::BIGINT AS need, (120 - legal_before)::BIGINT AS balls_left, (10 - wickets_before)::BIGINT AS wickets_left, round((target - score_before) * 6.0 / (120 - legal_before), 6) AS required_rate, round(coalesce(6.0 * score_before / nullif(legal_before, 0), 0), 6) AS current_rate, coalesce(r, 0) AS venue_rate, (runs >= target)::INT AS label
 FROM s JOIN tg ON tg.innings_id = s.innings_id LEFT JOIN vr ON vr.venue = s.venue WHERE target IS NOT NULL AND target - score_before > 0 AND 120 - legal_before > 0"""))
def win_matrix(s: SparkSession, d: str) -> DataFrame:
    return ft.win_matrix(ex(s, d), 2022)
