"""Value of a policy against the reward table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS, EFFICIENCY_WEIGHT, OPTIMALITY_WEIGHT, REWARDS
from triagemill.functions.rewards import grade_name


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def score_rewards(df: DataFrame, action: str = "action", grade: str = "grade_code", table=REWARDS) -> DataFrame:
    """Reward of the chosen action and the best possible one, row by row.

    The table is a constant flat array, indexed by grade and action.
    """
    width = len(table[0])
    cells = F.array(*[F.lit(float(v)) for row in table for v in row])
    best = F.array(*[F.lit(float(max(row))) for row in table])
    known = F.col(grade).between(0, len(table) - 1)
    row = F.when(known, F.col(grade)).otherwise(len(table) - 1).cast("int")
    return df.withColumns({
        "reward": F.get(cells, row * width + F.col(action).cast("int")), "best": F.get(best, row)})


def greedy_action(df: DataFrame) -> DataFrame:
    """Evaluation rule: the first greatest of q0, q1, q2."""
    q0, q1, q2 = F.col("q0"), F.col("q1"), F.col("q2")
    return df.withColumn("action", F.when((q0 >= q1) & (q0 >= q2), 0).when(q1 >= q2, 1).otherwise(2).cast("long"))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"), F.sum("reward").alias("_r"), F.sum("best").alias("_b"),
        F.count_if(F.col("reward") == F.col("best")).alias("_hit"),
        *[F.count_if(F.col("action") == i).alias(f"_n{i}") for i in range(len(ACTIONS))],
    ]


def evaluate_policy(scored: DataFrame, incident: str = "incident_id") -> DataFrame:
    """One row of policy metrics; zeros when there are no rows.

    The sums combine map-side to one row per task. The distinct incidents are
    counted by a subquery that reads the id column alone and runs beside them.
    """
    incidents = scored.agg(F.count_distinct(incident)).scalar()
    t = scored.agg(*_sums()).withColumn("incidents", incidents)
    r = F.coalesce(F.col("_r"), F.lit(0.0)).cast("double")
    b = F.coalesce(F.col("_b"), F.lit(0.0)).cast("double")
    rows = F.col("rows")
    return t.select(
        "rows", "incidents", r.alias("total_reward"), ratio_or_zero(r, rows).alias("average_reward"),
        ratio_or_zero(b, rows).alias("oracle_average_reward"), ratio_or_zero(r, b).alias("reward_efficiency"),
        ratio_or_zero(F.col("_hit"), rows).alias("policy_optimality"), (b - r).alias("reward_regret"),
        *[F.col(f"_n{i}").alias(f"n_{name}") for i, name in enumerate(ACTIONS)],
    )


def evaluate_by_class(scored: DataFrame, grade: str = "grade_code") -> DataFrame:
    """Per grade: rows, average reward and reward ratio."""
    t = scored.groupBy(grade).agg(*_sums()[:3])
    name = F.coalesce(grade_name(F.col(grade)), F.lit("Unknown"))
    return t.select(
        F.col(grade).cast("long").alias("grade_code"), name.alias("grade"), "rows",
        ratio_or_zero(F.col("_r"), F.col("rows")).alias("average_reward"),
        ratio_or_zero(F.col("_r"), F.col("_b")).alias("class_reward_ratio"))


def evaluate_all(scored: DataFrame, incident: str = "incident_id", grade: str = "grade_code") -> DataFrame:
    """Totals and every grade together, with the distinct incidents of the total.

    The big table is aggregated once by grade; the grouping sets that add the
    total run over those few rows, so no row of the table is duplicated.
    """
    incidents = scored.agg(F.count_distinct(incident)).scalar()
    by_grade = scored.groupBy(grade).agg(*_sums()[:4])
    t = by_grade.groupingSets([[grade], []], grade).agg(
        *[F.sum(c).alias(c) for c in ("rows", "_r", "_b", "_hit")], F.grouping_id().alias("_level"))
    total = F.col("_level") == 1
    rows = F.col("rows")
    return t.select(
        F.col(grade).cast("long").alias("grade_code"), total.alias("is_total"), "rows",
        F.when(total, incidents).alias("incidents"), F.col("_r").alias("total_reward"),
        ratio_or_zero(F.col("_r"), rows).alias("average_reward"),
        ratio_or_zero(F.col("_b"), rows).alias("oracle_average_reward"),
        ratio_or_zero(F.col("_r"), F.col("_b")).alias("reward_ratio"),
        ratio_or_zero(F.col("_hit"), rows).alias("policy_optimality"))


def action_distribution(scored: DataFrame, action: str = "action") -> DataFrame:
    """Count of every action, zeros kept, as (action, n)."""
    parts = [F.struct(F.lit(n).alias("action"), F.count_if(F.col(action) == i).alias("n")) for i, n in enumerate(ACTIONS)]
    return scored.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def reward_regret(scored: DataFrame) -> DataFrame:
    return scored.agg(F.coalesce(F.sum(F.col("best") - F.col("reward")), F.lit(0.0)).alias("regret"))


def sample_metrics(scored: DataFrame, key: str, n: int = 10000) -> DataFrame:
    """Metrics on ``n`` rows: those with the smallest key hash, a uniform sample.

    A top-k by hash keeps only ``n`` rows per task; it needs no full sort.
    """
    sample = scored.select(key, "action", "reward", "best").orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
    t = sample.agg(*_sums())
    return t.select(
        "rows", ratio_or_zero(F.col("_r"), F.col("rows")).alias("average_reward"),
        ratio_or_zero(F.col("_r"), F.col("_b")).alias("reward_efficiency"),
        *[F.col(f"_n{i}").alias(f"n_{name}") for i, name in enumerate(ACTIONS)])


def selection_score(optimality: Column, efficiency: Column) -> Column:
    return OPTIMALITY_WEIGHT * F.coalesce(optimality, F.lit(0.0)) + EFFICIENCY_WEIGHT * F.coalesce(efficiency, F.lit(0.0))


def champion(candidates: DataFrame, order: str) -> DataFrame:
    """The candidate with the highest score; the earlier one on a tie."""
    scored = candidates.withColumn(
        "validation_score", selection_score(F.col("policy_optimality"), F.col("reward_efficiency")))
    return scored.orderBy(F.desc("validation_score"), F.asc(order)).limit(1)


def reward_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, extremes (null when empty) and count and sum (0 when empty)."""
    return df.agg(
        F.avg(value).alias("mean_reward"), F.max(value).alias("max_reward"), F.min(value).alias("min_reward"),
        F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))


