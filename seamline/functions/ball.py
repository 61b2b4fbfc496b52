"""Classification of a delivery: Column functions over the columns of ``plans.views.COLUMNS``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcome codes, their names and nominal runs.
OUTCOMES = ["dot", "one", "two", "three", "four", "six", "wicket", "wide", "noball"]
NOMINAL_RUNS = [0, 1, 2, 3, 4, 6, 0, 1, 1]
CREDITED = ["caught", "bowled", "lbw", "caught and bowled", "stumped", "hit wicket", "hit the ball twice"]
WICKET_KINDS = [*CREDITED, "run out", "retired hurt", "retired out", "obstructing the field", "timed out"]
PHASES = {"powerplay": (0, 5), "middle": (6, 14), "death": (15, 19)}
SPIN, PACE = ["OB", "LB", "SLA", "SLW"], ["RAP", "LAP"]
CLASSES = [*PACE, *SPIN]


def total_runs() -> Column:
    return F.expr("runs_bat + wides + noballs + byes + legbyes + penalty")


def bowler_runs() -> Column:
    return F.expr("runs_bat + wides + noballs")


def extras() -> Column:
    return F.expr("wides + noballs + byes + legbyes + penalty")


def is_legal() -> Column:
    return F.expr("wides = 0 AND noballs = 0")


def phase(over: Column | str = "over") -> Column:
    over = F.col(over) if isinstance(over, str) else over
    return F.when(over < 6, "powerplay").when(over < 15, "middle").otherwise("death")


def in_phase(name: str) -> Column:
    """The phase as a closed range of overs; the last one ends with over 19 here."""
    return F.col("over").between(*PHASES[name])


def credited(kind: Column | str = "wicket") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(kind.isin(CREDITED), F.lit(False))


def costs_wicket(kind: Column | str = "wicket") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return kind.isNotNull() & (kind != "retired hurt")


def parse_wicket(kind: Column) -> Column:
    """The kind itself; null for none; an unknown kind is an error."""
    return F.when(kind.isNull() | kind.isin(WICKET_KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown wicket kind: "), kind)))


def outcome() -> Column:
    """Code 0 to 8: wicket before wide before no-ball before runs off the bat; 4 and 5 are four, 6 and more six."""
    r = F.col("runs_bat")
    return (
        F.when(costs_wicket(), 6).when(F.col("wides") > 0, 7).when(F.col("noballs") > 0, 8).when(r >= 6, 5).when(r >= 4, 4).when(r == 3, 3).when(r == 2, 2).when(r == 1, 1).otherwise(0)
    )


def moves_away(bowl_class: Column, hand: Column) -> Column:
    away = ((hand == "RHB") & bowl_class.isin("LB", "SLA", "LAP")) | ((hand == "LHB") & bowl_class.isin("OB", "SLW", "RAP"))
    return F.coalesce(away, F.lit(False))


def is_spin(bowl_class: Column) -> Column:
    return F.coalesce(bowl_class.isin(SPIN), F.lit(False))


def is_pace(bowl_class: Column) -> Column:
    return F.coalesce(bowl_class.isin(PACE), F.lit(False))


def cell(role: Column, phase_no: Column, opposition: Column) -> Column:
    """(role * 3 + phase) * 2 + opposition: twelve cells."""
    return (role * 3 + phase_no) * 2 + opposition


def uncell(index: Column) -> tuple[Column, Column, Column]:
    whole = lambda a, n: F.floor(a / n).cast("int")
    return whole(index, 6), F.pmod(whole(index, 2), F.lit(3)), F.pmod(index, F.lit(2))


def phase_no(over: Column | str = "over") -> Column:
    over = F.col(over) if isinstance(over, str) else over
    return F.when(over < 6, 0).when(over < 15, 1).otherwise(2)


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double") * scale, b.cast("double")), F.lit(0.0))


def grade(delta: Column) -> Column:
    return F.when(delta > 0.03, "good").when(delta < -0.03, "bad").otherwise("level")
