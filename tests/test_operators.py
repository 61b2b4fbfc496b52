"""Hand-computed fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import ball
from seamline.functions import text as tx
from seamline.operators import aggregate as ag
from seamline.operators import features as ft
from seamline.operators import models as mo
from seamline.operators import rates as ra
from seamline.operators import results as rs
from seamline.operators import simulate as si
from seamline.operators import windows as wi
from seamline.plans.registry_more import synthetic_model

DDL = "delivery_id long, innings_id long, match_id long, season int, over int, batter long, non_striker long, bowler long, player_out long, runs_bat int, wides int, noballs int, byes int, legbyes int, penalty int, wicket string, super_over boolean, batting_team int, bowling_team int, venue int"


def balls(spark, rows):
    """Rows of dicts over a plain dot ball."""
    base = {"innings_id": 0, "match_id": 0, "season": 2024, "over": 0, "batter": 0, "non_striker": 1, "bowler": 2, "player_out": None, "runs_bat": 0, "wides": 0, "noballs": 0, "byes": 0, "legbyes": 0, "penalty": 0, "wicket": None, "super_over": False, "batting_team": 0, "bowling_team": 1, "venue": 0}
    names = [c.split()[0] for c in DDL.split(", ")]
    return ag.classified(spark.createDataFrame([tuple(({"delivery_id": i} | base | r)[n] for n in names) for i, r in enumerate(rows)], DDL))


OVER = [{"runs_bat": 4}, {"runs_bat": 1}, {"wides": 1}, {"runs_bat": 6}, {"wicket": "caught", "player_out": 0}]


def test_volumes(spark):
    players = spark.createDataFrame([(0,), (1,), (2,)], "player long")
    got = {r.player: r for r in ag.volumes(balls(spark, OVER), players).collect()}
    assert (got[0].faced, got[0].runs, got[0].dismissals, got[0].innings) == (4, 11, 1, 1)
    assert (got[2].bowled, got[2].conceded, got[2].wickets, got[2].first_season, got[2].last_season) == (4, 12, 1, 2024, 2024)
    assert (got[1].faced, got[1].innings) == (0, 0)
    none = ag.volumes(balls(spark, [r | {"super_over": True} for r in OVER]), players)
    assert all(not any(r[1:]) for r in none.collect())


def test_distribution(spark):
    x = balls(spark, OVER)
    r = ag.with_rates(ag.distribution(x)).first()
    assert (r.deliveries, r.legal, r.bat_runs, r.extras, r.total, r.wickets, r.bowler_wickets, r.n_four, r.n_six, r.n_wide, r.n_wicket) == (5, 4, 11, 1, 12, 1, 1, 1, 1, 1, 1)
    for f in (ag.Filter(bowler=0), ag.Filter(overs=(1, 19)), ag.Filter(seasons=(2025, 2026)), ag.Filter(phase="death")):
        assert ag.distribution(f.apply(x)).first().deliveries == 0
    nobody = spark.createDataFrame([], "player long, hand string")
    r = ag.with_rates(ag.distribution(ag.Filter(hand="LHB").apply(x, nobody))).first()
    assert r.deliveries == 0 and r.economy == 0.0
    assert ag.parse_range("15-19") == (14, 18) and ag.parse_range("3-3") == (2, 2)
    with pytest.raises(ValueError):
        ag.parse_range("0-5")


def test_classification(spark):
    cases = [({"runs_bat": 5}, 4), ({"runs_bat": 7}, 5), ({"wicket": "stumped", "wides": 1}, 6), ({"wicket": "run out", "runs_bat": 2}, 6), ({"wicket": "retired hurt", "runs_bat": 1}, 1), ({"wides": 2}, 7), ({"noballs": 1, "runs_bat": 4}, 8), ({"runs_bat": 3}, 3), ({}, 0)]
    got = [r.outcome for r in balls(spark, [c for c, _ in cases]).orderBy("delivery_id").collect()]
    assert got == [o for _, o in cases]
    df = spark.createDataFrame([("caught",), (None,)], "k string")
    assert df.select(ball.parse_wicket(F.col("k"))).count() == 2
    with pytest.raises(Exception, match="unknown wicket kind"):
        spark.createDataFrame([("eaten",)], "k string").select(ball.parse_wicket(F.col("k"))).collect()


def test_graph(spark):
    rows = [{"runs_bat": 4}, {}, {"runs_bat": 6}, {"wicket": "caught", "player_out": 0}, {"batter": 1, "bowler": 3, "runs_bat": 4}, {"batter": 1, "bowler": 3, "runs_bat": 1, "wicket": "run out", "player_out": 1}, {"batter": 0, "bowler": 3, "super_over": True}]
    e = {(r.batter, r.bowler): r for r in ag.edge_rates(ag.edges(balls(spark, rows))).collect()}
    a, b = e[0, 2], e[1, 3]
    assert (a.balls, a.runs, a.outs, a.dots, a.fours, a.sixes, a.strike_rate, a.average) == (4, 10, 1, 1, 1, 1, 250.0, 10.0)
    assert b.outs == 0 and b.average is None and (0, 3) not in e


def test_running_state(spark):
    rows = [{"runs_bat": 0}, {"runs_bat": 4}, {"wides": 1}, {"runs_bat": 1}, {"noballs": 1}, {}, {}, {"wicket": "caught", "player_out": 0, "runs_bat": 0}, {"runs_bat": 2}]
    got = wi.running_state(balls(spark, rows)).orderBy("delivery_id").collect()
    assert [r.legal_ball for r in got] == [0, 1, 2, 2, 3, 3, 4, 5, 6]
    assert [r.score_before for r in got] == [0, 0, 4, 5, 6, 7, 7, 7, 7] and [r.wickets_before for r in got] == [0] * 8 + [1]
    assert [r.stand_runs for r in got] == [0, 0, 4, 5, 6, 7, 7, 7, 0]


def test_dismissals_that_cost(spark):
    kinds = [("retired hurt", 0), ("retired out", 1), ("run out", 1), ("caught", 1)]
    assert [int(r.costs) for r in balls(spark, [{"wicket": k} for k, _ in kinds]).orderBy("delivery_id").collect()] == [n for _, n in kinds]


def attributes(spark):
    return spark.createDataFrame([(0, "RHB"), (1, "LHB"), (9, None)], "player long, hand string"), spark.createDataFrame([(2, "RAP"), (3, "OB"), (8, None)], "player long, bowl_class string")


def test_cells(spark):
    bat, bowl = attributes(spark)
    rows = [{"over": 18, "runs_bat": 4}] * 10 + [{"over": 18, "runs_bat": 1, "batter": 1, "bowler": 3}] * 10 + [{"over": 18, "batter": 9, "bowler": 8}]
    c = ra.cell_counts(balls(spark, rows), bat, bowl)
    assert c.agg(F.sum("n")).first()[0] == 40
    got = {(r.cell, r.player): r.n for r in c.collect()}
    assert got == {(4, 2): 10, (5, 3): 10, (10, 0): 10, (11, 1): 10}
    post = ra.posteriors(c, ra.cell_stats(c), spark.createDataFrame([(0,), (2,)], "player long"), spark.range(12).selectExpr("cast(id as int) AS cell", "100.0D AS kappa"))
    empty = post.where("cell = 0 AND player = 2").collect()
    assert all(r.posterior == pytest.approx(1 / 9) and r.weight == 0 for r in empty)
    sums = post.groupBy("cell", "player").agg(F.sum("posterior").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_no_leak(spark):
    bat, bowl = attributes(spark)
    rows = [{"runs_bat": 4, "over": i // 6, "match_id": m, "innings_id": m, "season": 2023 + m} for m in range(2) for i in range(12)]
    x = balls(spark, rows)
    got = ft.extract(x, bat, bowl).orderBy("delivery_id").collect()
    assert len(got) == 24 and [r.h_balls for r in got] == [0.0] * 12 + [12.0] * 12
    assert {r.season for r in ft.season_rates_before(ra.cell_counts(x, bat, bowl), 100.0).select("season").distinct().collect()} == {2024}
    assert ft.extract(x, bat, bowl.where("player = 8")).count() == 0


@pytest.mark.parametrize("kappa", [20, 200, 2000])
def test_concentration_recovery(spark, kappa):
    rng = np.random.default_rng(kappa)
    prior = np.array([0.55, 0.25, 0.15, 0.05])
    rows = [(0, p, 2020, k, int(n), 0) for p in range(400) for k, n in enumerate(rng.multinomial(600, rng.dirichlet(prior * kappa))) if n]
    c = spark.createDataFrame(rows, "cell int, player long, season int, outcome int, n long, runs long")
    stats = ra.cell_stats(c)
    got = {r.cell: r.kappa for r in ra.fit_concentration(c, stats).collect()}
    assert kappa / 2 < got[0] < kappa * 2
    own = {}
    for _, p, _, k, n, _ in rows:
        own.setdefault(p, {})[k] = n
    total = sum(n for *_, n, _ in rows)
    pi = [sum(o.get(k, 0) for o in own.values()) / total for k in range(4)]
    want = sum(math.lgamma(100) - math.lgamma(sum(o.values()) + 100) + sum(math.lgamma(o.get(k, 0) + 100 * pi[k]) - math.lgamma(100 * pi[k]) for k in range(4)) for o in own.values())
    lm = ra.log_marginal(ra.count_sizes(c), stats, spark.createDataFrame([(0, 100.0)], "cell int, kappa double")).first().log_marginal
    assert lm == pytest.approx(want, rel=1e-9)
    slope = lambda k: sum(sum(pi[j] * sum(1 / (k * pi[j] + m) for m in range(o.get(j, 0))) for j in range(4)) - sum(1 / (k + m) for m in range(sum(o.values()))) for o in own.values())
    assert slope(got[0] * (1 - 1e-5)) > 0 > slope(got[0] * (1 + 1e-5))


def test_gamma_columns(spark):
    x = [10.0**k * m for k in range(-6, 8) for m in (1.0, 2.5, 7.0)]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", ra.log_gamma(F.col("x")).alias("g"), *[ra.digamma_rise(F.col("x"), F.lit(float(n))).alias(f"d{n}") for n in (1, 7, 5000)])
    for r in df.collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)
        for n in (1, 7, 5000):
            assert r[f"d{n}"] == pytest.approx(math.fsum(1 / (r.x + j) for j in range(n)), rel=1e-12)


def test_concentration_does_not_grow_with_the_counts(spark):
    few = spark.createDataFrame([(0, p, 2020, k, 3 + p % 2 + k, 0) for p in range(6) for k in range(3)], "cell int, player long, season int, outcome int, n long, runs long")
    many = few.withColumn("n", F.col("n") * 10**9)
    assert ra.count_sizes(many).count() == ra.count_sizes(few).count()
    assert ra.fit_concentration(many, ra.cell_stats(many)).first().kappa > 10


def test_concentration_of_one_player(spark):
    c = spark.createDataFrame([(0, 1, 2020, 0, 5, 0)], "cell int, player long, season int, outcome int, n long, runs long")
    assert ra.fit_concentration(c, ra.cell_stats(c)).first().kappa == 1e6


def test_results(spark):
    ddl = "id string, date string, player string, defended int, chased int, total_score double, finished_at long"
    r = spark.createDataFrame([("a", "d", "Cautious", 1, 0, 60.0, 1), ("b", "d", "Winner", 1, 1, 2.0, 2), ("c", "d", "AlsoWon", 1, 1, 10.0, 3), ("e", "d", " ", 1, 1, 99.0, 4)], ddl)
    assert [x.player for x in rs.daily_leaderboard(r, "d", 9).collect()] == ["AlsoWon", "Winner", "Cautious"]
    more = spark.createDataFrame([("f", "d", "Winner", 0, 0, 1.0, 5), ("g", "d", "", 0, 0, 1.0, 6), ("a", "x", "New", 0, 0, 1.0, 7), ("h", "x", "Two", 0, 0, 1.0, 9), ("i", "x", "Two", 0, 0, 1.0, 8)], ddl)
    assert sorted(x.id for x in rs.insert_runs(r, more).collect()) == ["a", "b", "c", "e", "g", "i"]
    assert rs.day_stats(r, "none").first().asDict() == {"runs": 0, "defended": 0.0, "chased": 0.0, "both": 0.0, "neither": 0.0, "mean_score": 0.0}
    assert rs.percentile(r, "d", 60.0).first()[0] == 50.0 and rs.percentile(r, "none", 1.0).first()[0] == 0.0
    with pytest.raises(KeyError):
        rs.set_player(r, "zz", "x")
    days = spark.createDataFrame([("p", d) for d in ("2024-01-01", "2024-01-03", "2024-01-04", "2024-01-04", "2024-01-05")], "player string, date string")
    assert [wi.streak(days, "p", d).first()[0] for d in ("2024-01-05", "2024-01-04", "2024-01-06", "2024-01-01")] == [3, 2, 0, 1]


def test_squad_rules(spark):
    pool = spark.createDataFrame([(i, 5) for i in range(6)], "player long, cost int")
    broken = lambda ids, budget=20: rs.squad_check(spark.createDataFrame([(i,) for i in ids], "player long"), pool, 3, budget).first().broken
    assert [broken(x) for x in ([0, 1], [0, 1, 77], [0, 1, 1], [0, 1, 2])] == ["wrong number", "not in the pool", "picked twice", None]
    assert broken([0, 1, 2], 14) == "over budget"


def test_scheduling_against_brute_force():
    from functools import cache

    @cache
    def can(left, last):
        return not any(left) or any(n and b != last and can(left[:b] + (n - 1,) + left[b + 1 :], b) for b, n in enumerate(left))

    states = [((a, b, c, d, e), last) for a in range(5) for b in range(5) for c in range(5) for d in range(5) for e in range(5) for last in range(-1, 5)]
    got = si.completable(np.array([s for s, _ in states]), np.array([x for _, x in states]))
    assert [bool(g) for g in got] == [can(s, x) for s, x in states]


CAND = si.Candidate(tuple(tuple(x) for x in [[0.35, 0.3, 0.06, 0.01, 0.11, 0.06, 0.05, 0.04, 0.02]] * 5))


def test_simulation_invariants(spark):
    keys = [f"k{i}" for i in range(40)]
    a, b = si.play_games(keys, np.full(40, 170), CAND), si.play_games(keys[::-1], np.full(40, 170), CAND)
    assert (a["score"] == b["score"][::-1]).all() and len(set(a["score"].tolist())) > 5
    assert (a["legal"] <= 120).all() and (a["wickets"] <= 10).all() and ((a["score"] >= 170) == (a["chased"] == 1)).all()
    g = si.Game(keys[:3], np.full(3, 400))
    for _ in range(20):
        bowler = si.reference_bowler(g, CAND.order())
        assert (bowler != g.last).all() or not g.live().any()
        si.play_over(g, bowler, np.full(3, si.ROTATE), CAND.predictor())
    assert (g.bowled <= si.CAP).all()
    games = si.reduce_games(si.monte_carlo(spark, CAND, [160], 64, "k")).first()
    assert games.games == 64 and games.defend_rate + games.chase_rate == pytest.approx(1)


def test_intents_and_tilts():
    p = np.array([[0.35, 0.3, 0.06, 0.01, 0.11, 0.06, 0.05, 0.04, 0.02]])
    w = [si.with_intent(p, np.array([si.ATTACK]), np.array([float(r)]))[0] for r in range(2, 15)]
    assert all(x.sum() == pytest.approx(1) for x in w) and all(a[6] >= b[6] - 1e-12 for a, b in zip(w, w[1:], strict=False))
    for scale in (0.75, 1.0, 1.35):
        q = si.newton_tilt(p, p @ si.RUNS * scale)
        assert q.sum() == pytest.approx(1) and (q @ si.RUNS)[0] == pytest.approx((p @ si.RUNS)[0] * scale, abs=1e-4)


def test_judge(spark):
    rows = [(0.50, 0.48, 0.022), (0.35, 0.65, 0.018), (0.80, 0.50, 0.022), (0.50, 0.85, 0.022), (0.50, 0.50, 0.004), (0.58, 0.44, 0.030), (0.5, 0.5, 0.018)]
    got = si.judged(spark.createDataFrame(rows, "defend_rate double, chase_rate double, spread double")).collect()
    assert [r.accepted for r in got] == [True, True, False, False, False, True, True] and got[5].rank_score > got[6].rank_score


def test_ensemble_matches_a_plain_walk(spark):
    text = synthetic_model()
    m = mo.parse_ensemble(text)
    x = np.random.default_rng(0).uniform(0, 25, (60, 6))
    x[0, 0] = np.nan
    want = np.zeros((60, 9))
    for r in range(60):
        for i, t in enumerate(m.trees):
            n = 0
            while n >= 0:
                v = x[r, t["feature"][n]]
                n = t["left"][n] if (t["default_left"][n] if np.isnan(v) else v <= t["threshold"][n]) else t["right"][n]
            want[r, i % 9] += t["leaf"][-n - 1]
    assert np.allclose(m.margins(x), want)
    for broken in (text.replace("num_cat=0", "num_cat=1", 1), text.replace("num_leaves=8", "num_leaves=9", 1), text.replace("num_class=9", "num_class=4")):
        with pytest.raises(ValueError):
            mo.parse_ensemble(broken)
    with pytest.raises(ValueError):
        mo.parse_ensemble(text, ["other"])


def test_temperature_and_keys(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(4000, 9)) * 2
    y = np.array([rng.choice(9, p=q) for q in mo.softmax(m, 1.7)])
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(m, y, strict=True)] + [(None, 1), ([1.0] * 9, None)], "m array<double>, y int")
    got = mo.fit_temperature(df, "m", "y")
    loss = lambda t: -np.log(mo.softmax(m, t)[np.arange(4000), y]).mean()
    assert 1.5 < got < 1.9 and loss(got) <= min(loss(t) for t in np.linspace(1.4, 2, 601)) + 1e-12
    sure = df.withColumn("y", F.expr("cast(array_position(m, array_max(m)) - 1 as int)"))
    assert mo.fit_temperature(sure, "m", "y") == pytest.approx(math.exp(-2)) and mo.fit_temperature(df.where("y > 99"), "m", "y") == 1
    assert ra.affordable([9, 9, 3], 2, 8) == [5, 5, 3]


def test_ranges_of_a_column_are_those_of_the_parser(spark):
    texts = ["15-19", "3-3", "0-5", "5-4", "19-21", "7", "", None, " 1 - 20 ", "1--2", "a-b", "-1-3", "1-2-3", "999999999999-2", "1-20"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[c.alias(n) for c, n in zip(ag.range_of(F.col("t")), ("lo", "hi"), strict=True)]).collect()
    for r in got:
        try:
            want = ag.parse_range(r.t or "")
        except ValueError:
            want = (None, None)
        assert (r.lo, r.hi) == want, r.t
