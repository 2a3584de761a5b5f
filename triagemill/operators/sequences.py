"""Ordered alerts: transitions inside incidents, returns, advantages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS
from triagemill.functions.rewards import rewards_of
from triagemill.operators.ordered import positioned


def order_incidents(df: DataFrame, incident: str = "incident_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Number the alerts of each incident by time; unreadable times come last.

    Alerts without an incident are kept as a group of their own.
    """
    return positioned(df, [incident], time, tie)


def transitions(
    df: DataFrame, state: str = "state", incident: str = "incident_id", time: str = "ts", tie: str = "event_id",
) -> DataFrame:
    """Next state, step and end flag; the last alert of an incident keeps its own state.

    Alerts without an incident are left out, as by the reference's groupby.
    """
    rows = positioned(df.filter(F.col(incident).isNotNull()), [incident], time, tie, following=state)
    done = F.col("position") == F.col("group_size") - 1
    return rows.withColumns({
        "step": F.col("position"), "done": done,
        f"next_{state}": F.when(done, F.col(state)).otherwise(F.col(f"next_{state}")),
    }).drop("position", "group_size")


def action_expanded_transitions(steps: DataFrame, grade: str = "grade_code") -> DataFrame:
    """One row per alert and action with the reward of that action."""
    rewards = rewards_of(F.col(grade))
    options = F.array(*[
        F.struct(F.lit(i).cast("long").alias("action"), F.get(rewards, F.lit(i)).alias("reward")) for i in range(len(ACTIONS))])
    return steps.select("*", F.inline(options))


def logged_transitions(steps: DataFrame, logged: str = "logged_action", grade: str = "grade_code") -> DataFrame:
    """Only alerts whose logged action is one of the action codes."""
    action = F.col(logged).cast("string").try_cast("int")
    rewards = rewards_of(F.col(grade))
    return (
        steps.withColumn("action", action.cast("long"))
        .filter(F.col("action").between(0, len(ACTIONS) - 1))
        .withColumn("reward", F.get(rewards, F.col("action").cast("int")))
    )


def discounted_return(
    df: DataFrame, gamma: float, reward: str = "reward", keys: Sequence[str] = ("incident_id",),
    time: str = "ts", tie: str = "event_id", longest: int = 50_000,
) -> DataFrame:
    """G of each row: its reward plus gamma times G of the next row of the key.

    A key is cut by step into pieces of at most ``longest`` rows, short enough
    that gamma to that power stays far above underflow. Suffix sums run inside
    a piece, and the sums of the following pieces are carried back.
    """
    keys = list(keys)
    if not 0.0 < gamma <= 1.0:
        raise ValueError("gamma must be in (0, 1]")
    length, reach = longest, None
    if gamma < 1.0:
        decay = -math.log(gamma)
        length = max(1, min(longest, int(230 / decay)))
        reach = max(1, math.ceil(700 / (length * decay)))  # pieces until the weight vanishes
    rows = positioned(df, keys, time, tie)
    rows = rows.withColumn("_piece", F.floor(F.col("position") / length)).withColumn("_at", F.col("position") % length)
    weight = F.pow(F.lit(float(gamma)), F.col("_at"))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = rows.withColumn("_own", F.sum(F.col(reward) * weight).over(inside) / weight)
    pieces = rows.groupBy(*keys, "_piece").agg(F.sum(F.col(reward) * weight).alias("_sum"))
    frame = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(1, reach or Window.unboundedFollowing)
    if reach is None:
        carried = F.coalesce(F.sum("_sum").over(frame), F.lit(0.0))
    else:
        later = F.collect_list("_sum").over(frame)  # at most ``reach`` numbers
        carried = F.aggregate(F.reverse(later), F.lit(0.0), lambda s, x: x + s * F.lit(gamma**length))
    pieces = pieces.select(*keys, "_piece", carried.alias("_carried"))
    left = F.least(F.lit(length), F.col("group_size") - F.col("_piece") * length) - F.col("_at")
    names = [f"_k{i}" for i in range(len(keys))]
    pieces = pieces.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_piece").alias("_p"), "_carried")
    same = F.col("_piece") == F.col("_p")
    for k, n in zip(keys, names):  # rows without a key are one sequence
        same = same & F.col(k).eqNullSafe(F.col(n))
    return (
        local.join(pieces, same).drop("_p", *names)
        .withColumn("return", F.col("_own") + F.pow(F.lit(float(gamma)), left) * F.col("_carried"))
        .drop("_piece", "_at", "_own", "_carried")
    )


def normalised_advantage(df: DataFrame, batch: str, returns: str, values: str) -> DataFrame:
    """(G - V) standardised inside a batch when it has spread.

    The moments are aggregated and joined back; no window holds a whole batch.
    """
    rows = df.withColumn("_a", F.col(returns) - F.col(values))
    stats = rows.groupBy(F.col(batch).alias("_batch")).agg(
        F.avg("_a").alias("_mean"), F.stddev_pop("_a").alias("_std"), F.count("_a").alias("_n"))
    wide = (F.col("_n") > 1) & (F.col("_std") > 1e-8)
    scaled = F.when(wide, (F.col("_a") - F.col("_mean")) / (F.col("_std") + 1e-8)).otherwise(F.col("_a"))
    same = F.col(batch).eqNullSafe(F.col("_batch"))
    return rows.join(stats, same).withColumn("advantage", scaled).drop("_a", "_batch", "_mean", "_std", "_n")
