"""Deterministic simulation: many games in step in numpy, a row a game outside.

The state of a batch of games is a set of arrays; each step plays one ball of
every live game. Draws are keyed by game, innings, over, ball and choice, so
results do not depend on batches, order or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions.ball import NOMINAL_RUNS

OVERS, BALLS, WICKETS, CAP, MAX_DELIVERIES, MAX_ATTACKS = 20, 120, 10, 4, 200, 6
INTENT_STRENGTH = np.array([-0.30, 0.0, 0.34])  # block, rotate, attack
BLOCK, ROTATE, ATTACK = 0, 1, 2
RUNS = np.array(NOMINAL_RUNS, float)


def completable(remaining: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each row's overs left by bowler can be bowled with no two in a row, after ``last`` (-1 for none).

    The most that one bowler may have is half of the overs left, rounded up;
    with an odd number and exactly that many, it may not be who bowled last.
    """
    n, top = remaining.sum(axis=1), remaining.max(axis=1)
    half = (n + 1) // 2
    same = (last >= 0) & (np.take_along_axis(remaining, np.maximum(last, 0)[:, None], 1)[:, 0] == half) & (n % 2 == 1)
    # an even number: the last bowler may have half at most, which the first rule says
    return (n == 0) | ((top <= half) & ~same)


def completable_column(remaining: Column, last: Column) -> Column:
    n = F.aggregate(remaining, F.lit(0), lambda a, b: a + b)
    half = F.floor((n + 1) / 2)
    same = (last >= 0) & (F.coalesce(F.get(remaining, last), F.lit(-1)) == half) & (F.pmod(n, F.lit(2)) == 1)
    return (n == 0) | ((F.array_max(remaining) <= half) & ~same)


def legal_bowlers(bowled: np.ndarray, last: np.ndarray, over: np.ndarray) -> np.ndarray:
    """(games, bowlers): under the cap, not the last one's bowler, and leaving an innings that can be finished."""
    games, k = bowled.shape
    ok = (bowled < CAP) & (np.arange(k)[None, :] != last[:, None])
    for b in range(k):
        left = CAP - bowled
        left[:, b] -= 1
        spare = left.sum(axis=1) - (OVERS - over - 1)
        # with overs to spare a bowler need not use all of them, so only the exact case binds
        fits = completable(np.maximum(left, 0), np.full(games, b)) | (spare > 0)
        ok[:, b] &= fits
    return ok


def tilted(p: np.ndarray, strength: np.ndarray) -> np.ndarray:
    w = p * np.exp(strength[:, None] * RUNS)
    z = w.sum(axis=1, keepdims=True)
    return np.where((strength[:, None] == 0) | (z <= 0), p, w / np.maximum(z, 1e-300))


def with_intent(p: np.ndarray, intent: np.ndarray, required: np.ndarray) -> np.ndarray:
    out = tilted(p, INTENT_STRENGTH[intent])
    risky = (intent == ATTACK) & (required < 7)
    w = np.minimum(out[:, 6] * (1 + 1.8 * (7 - required) / 7), 1.0)
    scaled = out * ((1 - w) / np.maximum(1 - out[:, 6], 1e-12))[:, None]
    scaled[:, 6] = w
    return np.where(risky[:, None], scaled, out)


def newton_tilt(p: np.ndarray, want: np.ndarray, rounds: int = 6, most: float = 0.8) -> np.ndarray:
    """``p`` tilted so that its mean runs come to ``want``: Newton on the strength, kept within ``most``."""
    s = np.zeros(len(p))
    for _ in range(rounds):
        q = tilted(p, np.where(s == 0, 1e-12, s))
        mean = q @ RUNS
        s = np.clip(s - (mean - want) / np.maximum(q @ RUNS**2 - mean**2, 1e-9), -most, most)
    return tilted(p, s)


def draws(keys: list[str], innings: int, over: np.ndarray, ball: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The keyed draws of ``models.draw``, here for a batch."""
    out = np.empty(len(keys))
    for i, (k, o, b, c) in enumerate(zip(keys, over.tolist(), ball.tolist(), choice.tolist(), strict=True)):
        out[i] = int(hashlib.sha256(f"{k}|{innings}|{o}|{b}|{c}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return out


@dataclass
class Game:
    """A batch of innings: arrays by game."""

    keys: list[str]
    target: np.ndarray
    bowlers: int = 5
    score: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.keys)
        z = lambda *s: np.zeros(s or n, np.int64)
        self.score, self.wickets, self.legal, self.over, self.deliveries, self.attacks = z(), z(), z(), z(), z(), z()
        self.striker, self.other, self.next_in, self.last = z(), z() + 1, z() + 2, z() - 1
        self.bowled, self.conceded = z(n, self.bowlers), z(n, self.bowlers)

    def live(self) -> np.ndarray:
        return (self.score < self.target) & (self.wickets < WICKETS) & (self.legal < BALLS) & (self.deliveries < MAX_DELIVERIES)

    def required(self) -> np.ndarray:
        return 6.0 * np.maximum(self.target - self.score, 0) / np.maximum(BALLS - self.legal, 1)


Predictor = Callable[["Game", np.ndarray], np.ndarray]  # (state, bowler of each game) -> (games, 9) probabilities


def play_over(g: Game, bowler: np.ndarray, intent: np.ndarray, predict: Predictor, innings: int = 2) -> None:
    """Plays one over in every live game: six legal balls, or until it is over."""
    start, went = g.live().copy(), g.legal.copy()
    for nth in range(MAX_DELIVERIES):
        on = start & g.live() & (g.legal - went < 6)
        if not on.any():
            break
        p = with_intent(predict(g, bowler), intent, g.required())
        at = np.flatnonzero(on)
        u = draws([g.keys[i] for i in at], innings, g.over[at], np.full(len(at), nth), bowler[at] + 16 * intent[at])
        cum = np.cumsum(p[at], axis=1)
        hit = np.minimum((u[:, None] >= cum).sum(axis=1), 8)
        hit = np.where(u >= cum[:, -1], 8 - np.argmax(p[at][:, ::-1] > 0, axis=1), hit)  # rounding: the last possible one
        runs, extra = RUNS[hit].astype(int), hit >= 7
        g.score[at] += runs
        g.conceded[at, bowler[at]] += runs
        g.deliveries[at] += 1
        g.legal[at[~extra]] += 1
        out = at[hit == 6]
        g.wickets[out] += 1
        g.striker[out] = g.next_in[out]
        g.next_in[out] += 1
        swap = at[~extra & (runs % 2 == 1)]
        g.striker[swap], g.other[swap] = g.other[swap], g.striker[swap].copy()
    g.striker[start], g.other[start] = g.other[start], g.striker[start].copy()
    g.bowled[np.flatnonzero(start), bowler[start]] += 1
    g.attacks[start & (intent == ATTACK)] += 1
    g.last[start] = bowler[start]
    g.over[start] += 1


def intent_rules(wickets: Column, required: Column, overs_left: Column, attacks_left: Column, over: Column) -> Column:
    """The reference batting policy: block in a collapse, attack when the budget need not be saved, the rate asks for it or the end is near."""
    can = attacks_left > 0
    return F.when((wickets >= 8) & (required < 12), "block").when(can & ((attacks_left >= overs_left) | (required > 9) | (over >= 15)), "attack").otherwise("rotate")


def reference_intent(g: Game) -> np.ndarray:
    """``intent_rules`` for a batch."""
    req, left, balls = g.required(), MAX_ATTACKS - g.attacks, BALLS - g.legal
    attack = (left > 0) & ((left >= (balls + 5) // 6) | (req > 9) | (g.over >= 15))
    return np.select([balls == 0, (g.wickets >= 8) & (req < 12), attack], [ROTATE, BLOCK, ATTACK], ROTATE)


def needed_intent(g: Game) -> np.ndarray:
    """Attack when the rate has climbed out of reach, block with wickets down and the rate in hand."""
    req = g.required()
    return np.select([(g.wickets >= 6) & (req < 11), (req > 9.5) & (g.attacks < MAX_ATTACKS), (req < 6.5) & (g.wickets >= 4)], [BLOCK, ATTACK, BLOCK], ROTATE)


def reference_bowler(g: Game, order: np.ndarray) -> np.ndarray:
    """The first legal bowler of ``order`` (best at the death first); before over 15 the best two only if no other is legal."""
    ok = legal_bowlers(g.bowled, g.last, g.over)
    k = g.bowlers
    rank = np.empty(k, int)
    rank[order] = np.arange(k)
    early = g.over < 15
    cost = rank[None, :] + np.where(early[:, None] & (rank[None, :] < 2), 100, 0)
    cost = np.where(ok, cost, 10_000)
    return cost.argmin(axis=1)


def policy_bowler(g: Game, name: str, expected: np.ndarray) -> np.ndarray:
    """best, worst, first or save_best of the legal bowlers, by expected runs."""
    ok = legal_bowlers(g.bowled, g.last, g.over)
    if name == "first":
        return np.argmax(ok, axis=1)
    cost = np.broadcast_to(expected if name != "worst" else -expected, ok.shape).astype(float)
    if name == "save_best":
        cost = cost + np.where((np.argsort(np.argsort(expected)) < 2)[None, :] & (g.over < 15)[:, None], 100.0, 0.0)
    return np.where(ok, cost, 1e9).argmin(axis=1)


CHASES: dict[str, Callable[[Game], np.ndarray]] = {
    "never": lambda g: np.full(len(g.keys), ROTATE),
    "early": lambda g: np.where(g.over < MAX_ATTACKS, ATTACK, ROTATE),
    "late": lambda g: np.where(g.over >= OVERS - MAX_ATTACKS, ATTACK, ROTATE),
    "needed": needed_intent,
    "reference": reference_intent,
}


def win_probability(need: np.ndarray, balls: np.ndarray, wickets: np.ndarray) -> np.ndarray:
    """A plain logistic of rate and wickets in hand, with certainties first."""
    rate = 6.0 * need / np.maximum(balls, 1)
    p = 1 / (1 + np.exp(-(0.35 * (wickets - 5) - 0.9 * (rate - 8.5))))
    return np.where(need <= 0, 1.0, np.where((balls <= 0) | (wickets <= 0) | (need > 6 * balls), 0.0, p))


def one_ply_intent(g: Game, bowler: np.ndarray, predict: Predictor) -> np.ndarray:
    """The intent after whose six balls the projected win probability is highest; the first of equals."""
    p, req = predict(g, bowler), g.required()
    best, out = np.full(len(g.keys), -1.0), np.zeros(len(g.keys), int)
    for i in (BLOCK, ROTATE, ATTACK):
        q = with_intent(p, np.full(len(p), i), req)
        wp = win_probability(g.target - g.score - 6 * (q @ RUNS), BALLS - g.legal - 6, WICKETS - g.wickets - 6 * q[:, 6])
        if i == ATTACK:
            wp = np.where(g.attacks < MAX_ATTACKS, wp, -1.0)
        out = np.where(wp > best, i, out)
        best = np.maximum(best, wp)
    return out


def decision_values(options: DataFrame, chosen: str = "chosen") -> DataFrame:
    """Of (decision, side, option, wp, chosen): the chosen option's probability less the mean of all, from the chooser's side; 0 with one option."""
    g = options.groupBy("decision", "side").agg(F.count("*").alias("options"), F.avg("wp").alias("mean"), F.max(F.when(F.col(chosen), F.col("wp"))).alias("wp"))
    gap = F.when(F.col("options") < 2, 0.0).otherwise(F.when(F.col("side") == "bowling", -1).otherwise(1) * (F.col("wp") - F.col("mean")))
    return g.select("decision", "side", "options", F.round(gap, 6).alias("value"))


@dataclass(frozen=True)
class Candidate:
    """A set-up: each bowler's outcome probabilities (rows of nine)."""

    probabilities: tuple[tuple[float, ...], ...]

    def predictor(self) -> Predictor:
        p = np.array(self.probabilities)
        return lambda g, bowler: p[bowler]

    def order(self) -> np.ndarray:
        return np.argsort(np.array(self.probabilities) @ RUNS, kind="stable")


def play_games(keys: list[str], target: np.ndarray, cand: Candidate, policy: str = "reference", chase: str = "reference") -> dict[str, np.ndarray]:
    g = Game(keys, np.asarray(target), len(cand.probabilities))
    predict, order, expected = cand.predictor(), cand.order(), np.array(cand.probabilities) @ RUNS
    spread, n = np.zeros(len(keys)), np.zeros(len(keys))
    for _ in range(OVERS):
        live = g.live()
        if not live.any():
            break
        bowler = reference_bowler(g, order) if policy == "reference" else policy_bowler(g, policy, expected)
        ok = legal_bowlers(g.bowled, g.last, g.over)
        lo, hi = np.where(ok, expected, np.inf).min(axis=1), np.where(ok, expected, -np.inf).max(axis=1)
        wp = [win_probability(g.target - g.score - 6 * x, BALLS - g.legal - 6, WICKETS - g.wickets) for x in (lo, hi)]
        swing = np.abs(np.nan_to_num(wp[1] - wp[0]))
        count = live & (ok.sum(axis=1) > 1)
        spread[count], n[count] = spread[count] + swing[count], n[count] + 1
        play_over(g, bowler, CHASES[chase](g), predict)
    return {"score": g.score, "wickets": g.wickets, "legal": g.legal, "chased": (g.score >= g.target).astype(int), "spread": spread, "spread_n": n}


def monte_carlo(spark: SparkSession, cand: Candidate, targets: list[int], games: int, key: str, policies: list[str] = ["reference"], chases: list[str] = ["reference"]) -> DataFrame:  # noqa: B006
    """A row a game of every target, policy and chase: all of them in one job."""
    grid = spark.range(games).withColumnRenamed("id", "game").crossJoin(spark.createDataFrame([(t, p, c) for t in targets for p in policies for c in chases], "target int, policy string, chase string"))
    held = spark.sparkContext.broadcast(cand)

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for (policy, chase), part in pdf.groupby(["policy", "chase"], sort=True):
                out = play_games([f"{key}/{i}" for i in part["game"]], part["target"].to_numpy(), held.value, policy, chase)
                yield pd.DataFrame({"game": part["game"].to_numpy(), "target": part["target"].to_numpy(), "policy": policy, "chase": chase} | out)

    parts = max(1, min(spark.sparkContext.defaultParallelism * 2, games * len(targets) // 64 + 1))
    return grid.repartition(parts).mapInPandas(run, "game long, target int, policy string, chase string, score long, wickets long, legal long, chased int, spread double, spread_n double")


def reduce_games(games: DataFrame) -> DataFrame:
    """(target, policy, chase) with games, chase and defence rates, mean score and decision spread."""
    g = games.groupBy("target", "policy", "chase").agg(F.count("*").alias("games"), F.sum("chased").alias("c"), F.sum("score").alias("s"), F.sum("spread").alias("sp"), F.sum("spread_n").alias("n"))
    return g.select("target", "policy", "chase", "games", F.round(1 - F.col("c") / F.col("games"), 6).alias("defend_rate"), F.round(F.col("c") / F.col("games"), 6).alias("chase_rate"), F.round(F.col("s") / F.col("games"), 6).alias("mean_score"), F.round(F.coalesce(F.try_divide(F.col("sp"), F.col("n")), F.lit(0.0)), 6).alias("spread"))


def judged(evaluations: DataFrame) -> DataFrame:
    """Adds rejections (all of them, joined), accepted and score to (defend_rate, chase_rate, spread)."""
    band = lambda c, name: F.when(~F.col(c).between(0.35, 0.65), F.lit(f"{name} out of band"))
    why = F.concat_ws("; ", band("defend_rate", "defence"), band("chase_rate", "chase"), F.when(F.col("spread") < 0.018, "decisions matter too little"))
    balance = 1 - (F.abs(F.col("defend_rate") - 0.5) + F.abs(F.col("chase_rate") - 0.5)) / 2
    return evaluations.withColumn("rejections", why).withColumn("accepted", why == "").withColumn("rank_score", F.round(10 * F.col("spread") + balance, 6))


def solve_target(spark: SparkSession, cand: Candidate, key: str, games: int = 200, lo: int = 140, hi: int = 245, rounds: int = 6) -> int:
    """Bisection for the target at which defending and chasing are as likely; a job a round."""
    for _ in range(rounds):
        if hi - lo <= 3:
            break
        mid = (lo + hi) // 2
        r = reduce_games(monte_carlo(spark, cand, [mid], games, key)).first()
        if r.defend_rate < r.chase_rate:
            lo = mid
        else:
            hi = mid
    return (lo + hi) // 2


def best_accepted(evaluations: DataFrame, first: int = 3) -> DataFrame:
    """Of each date's first ``first`` accepted attempts the one with the highest score."""
    from pyspark.sql import Window as W

    ok = evaluations.where("accepted").withColumn("_n", F.row_number().over(W.partitionBy("date").orderBy("attempt"))).where(F.col("_n") <= first)
    return ok.groupBy("date").agg(F.max_by("attempt", F.struct("rank_score", -F.col("attempt"))).alias("attempt"), F.max("rank_score").alias("rank_score"))


def deal_attack(pool: DataFrame, key: str) -> DataFrame:
    """Five bowlers from a pool ranked by economy: 2 of the first third, 1 of the middle, 2 of the last, in a keyed order; pace and spin both present if the pool has them."""
    from pyspark.sql import Window as W

    from seamline.operators.windows import terciles

    t = terciles(pool, "economy").withColumn("at", F.sha2(F.concat(F.lit(key + "|"), F.col("player").cast("string")), 256))
    t = t.withColumn("n", F.row_number().over(W.partitionBy("tier").orderBy("at")))
    dealt = t.where(F.col("n") <= F.when(F.col("tier") == 1, 1).otherwise(2))
    kinds = dealt.agg(F.count_if("is_spin").alias("spinners"), F.count("*").alias("dealt"))
    need = t.crossJoin(kinds).withColumn("want_spin", F.col("spinners") == 0).withColumn("want_pace", F.col("spinners") == F.col("dealt"))
    swap = need.where(((F.col("want_spin") & F.col("is_spin")) | (F.col("want_pace") & ~F.col("is_spin"))) & (F.col("n") > F.when(F.col("tier") == 1, 1).otherwise(2))).orderBy("at").limit(1)
    kept = dealt.join(swap.select(F.lit(1).alias("tier"), F.lit(True).alias("_swap")), "tier", "left").where("_swap IS NULL")
    return kept.select("player", "economy", "is_spin", "tier").unionByName(swap.select("player", "economy", "is_spin", F.lit(1).alias("tier")))
