"""Reward definitions as column expressions; nothing here shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS, GRADES, REWARDS


def overridden(overrides: dict[str, dict[str, float]], table=REWARDS) -> list[list[float]]:
    """Reward cells replaced by (grade name, action name); unknown names are ignored."""
    cells = [list(row) for row in table]
    for grade, by_action in overrides.items():
        for action, value in by_action.items():
            if grade in GRADES and action in ACTIONS:
                cells[GRADES.index(grade)][ACTIONS.index(action)] = float(value)
    return cells


def rewards_of(grade_code: Column, table=REWARDS) -> Column:
    """Array of the rewards of all actions; an unknown grade uses the last row."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table])
    known = grade_code.between(0, len(table) - 1)
    return F.get(rows, F.when(known, grade_code).otherwise(len(table) - 1).cast("int"))


def reward_matrix(df: DataFrame, grade: str = "grade_code", table=REWARDS) -> DataFrame:
    rewards = rewards_of(F.col(grade), table)
    return df.withColumns({f"r_{name}": rewards[i] for i, name in enumerate(ACTIONS)})


def best_reward(df: DataFrame) -> DataFrame:
    """Highest reward and the first action that reaches it."""
    rewards = F.array(*[F.col(f"r_{name}") for name in ACTIONS])
    best = F.array_max(rewards)
    return df.withColumns({
        "best_reward": best,
        "oracle_action": (F.array_position(rewards, best) - 1).cast("long"),
    })


def grade_name(code: Column, strict: bool = False) -> Column:
    known = code.between(0, len(GRADES) - 1)
    name = F.get(F.array(*[F.lit(g) for g in GRADES]), F.when(known, code).cast("int"))
    if strict:
        return F.when(known, name).otherwise(F.raise_error(F.concat(F.lit("unknown grade "), F.coalesce(code.cast("string"), F.lit("null")))))
    return name


def action_name(code: Column) -> Column:
    known = code.between(0, len(ACTIONS) - 1)
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), F.when(known, code).cast("int"))


def code_of(name: Column, names: list[str]) -> Column:
    """Position of a name in a list of names, null when it is not there."""
    spot = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(spot > 0, spot - 1).cast("long")


def historical_reward(grade: Column, action: Column) -> Column:
    """Outcome reward by the expected action of a grade; a bad code is an error."""
    expected = F.get(F.array(*[F.lit(a) for a in (0, 0, 1, 2)]), F.when(grade.between(0, 3), grade).cast("int"))
    match = F.get(F.array(*[F.lit(v) for v in (8.0, 20.0, 3.0)]), expected.cast("int"))
    valid = expected.isNotNull() & action.between(0, 2)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), F.raise_error(F.lit("unsupported grade or action")).cast("double"))
        .when(action == expected, match)
        .when((grade == 2) & (action == 0), -40.0)
        .when(grade.isin(0, 1) & (action == 1), -15.0)
        .when(grade == 3, -8.0)
        .otherwise(-12.0)
    )


def feedback_reward(outcome: Column, correct: Column, seconds: Column) -> Column:
    base = (
        F.when(outcome == "failed", -20.0)
        .when(correct, 10.0)
        .when(~correct, -15.0)
        .when(outcome == "approved", 2.0)
        .when(outcome.isin("rejected", "cancelled"), -5.0)
        .when(outcome == "executed", 1.0)
        .otherwise(F.raise_error(F.lit("unsupported outcome")).cast("double"))
    )
    penalty = (
        F.when(seconds < 0, F.raise_error(F.lit("negative processing time")).cast("double"))
        .when(seconds.isNull(), 0.0)
        .otherwise(F.least(seconds * 0.1, F.lit(8.0)))
    )
    return F.greatest(F.lit(-50.0), F.least(F.lit(50.0), base - penalty))


def label_reward(label: Column, action: Column) -> Column:
    """Reward by the verified grade label; other labels are neutral."""
    label = F.trim(label)
    hit = F.when(label == "TruePositive", F.when(action == 1, 2.0).when(action == 2, 1.0).otherwise(-2.0))
    return hit.when(
        label.isin("FalsePositive", "BenignPositive"),
        F.when(action == 0, 1.5).when(action == 2, 0.25).otherwise(-2.0),
    ).otherwise(0.0)


def severity_reward(label: Column, code: Column, action: Column) -> Column:
    """By the label when there is one, else by the code; neither is an error."""
    name = F.coalesce(label, grade_name(code, strict=True))
    return label_reward(name, action)


def false_positive_reward(verdict: Column, suspicion: Column, action: Column) -> Column:
    """Cost of a needless escalation; the verdict is asked before the suspicion."""
    verdict = F.trim(F.coalesce(verdict, F.lit("Unknown")))
    level = F.trim(F.coalesce(suspicion, F.lit("Unknown")))
    cost = (
        F.when(verdict == "Benign", -15.0)
        .when(verdict == "Unknown", -2.0)
        .when(level == "Low", -2.0)
        .when(level == "High", 1.0)
        .otherwise(0.0)
    )
    return F.when(action == 1, cost).otherwise(0.0)


def analyst_reward(suspicion: Column, grouped: Column, granular: Column, action: Column) -> Column:
    level = F.trim(F.coalesce(suspicion, F.lit("Unknown")))
    group = F.trim(F.coalesce(grouped, F.lit("Unknown")))
    detail = F.trim(F.coalesce(granular, F.lit("Unknown")))
    load = (
        F.when(level == "Low", F.when(action == 0, 4.0).otherwise(-4.0))
        .when(level == "Medium", F.when(action == 0, 2.0).otherwise(-2.0))
        .when(level == "High", F.when(action == 1, 4.0).otherwise(-4.0))
        .otherwise(0.0)
    )
    agrees = ((action == 1) & group.contains("Escal")) | (
        (action == 0) & (group.contains("Close") | group.contains("Ignore"))
    )
    known = F.when(detail == "Unknown", 0.0).when(action == 1, 1.0).otherwise(0.5)
    return load + F.when(agrees, 2.0).otherwise(0.0) + known


def latency_reward(seconds: Column) -> Column:
    return (
        F.when(seconds < 0, F.raise_error(F.lit("negative processing time")).cast("double"))
        .when(seconds.isNull() | (seconds <= 2), 0.0)
        .otherwise(-F.least(seconds * 0.1, F.lit(8.0)))
    )


@dataclass(frozen=True)
class CompositeConfig:
    analyst: bool = True
    latency: bool = True
    clipping: bool = True
    low: float = -50.0
    high: float = 50.0


def composite_reward(df: DataFrame, action: str, config: CompositeConfig = CompositeConfig()) -> Column:
    """Sum of the shaped rewards over the usual alert columns."""
    a = F.col(action)
    total = severity_reward(F.col("grade"), F.col("grade_code"), a)
    total = total + false_positive_reward(F.col("verdict"), F.col("suspicion"), a)
    if config.analyst:
        total = total + analyst_reward(F.col("suspicion"), F.col("action_grouped"), F.col("action_granular"), a)
    if config.latency:
        total = total + latency_reward(F.col("processing_s"))
    if config.clipping:
        total = F.greatest(F.lit(config.low), F.least(total, F.lit(config.high)))
    return total
