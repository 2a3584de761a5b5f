"""Policy evaluation (G10-G18) on the large and the event-based alert view."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.soc_queries import rounded
from triagemill.operators import evaluate as E


def big_scored(v):
    return E.score_rewards(E.greedy_action(v.alerts_big()))


def scored(v):
    return E.score_rewards(E.greedy_action(v.alerts()))


@query("G10_evaluate_policy", """
SELECT count(*) AS rows, count(DISTINCT incident_id) AS incidents, sum(reward) AS total_reward, round(avg(reward), 6) AS average_reward,
  round(avg(best), 6) AS oracle_average_reward, round(sum(reward) / sum(best), 6) AS reward_efficiency,
  round(count(*) FILTER (WHERE reward = best) / count(*)::DOUBLE, 6) AS policy_optimality, sum(best) - sum(reward) AS reward_regret,
  count(*) FILTER (WHERE a = 0) AS n_allow, count(*) FILTER (WHERE a = 1) AS n_block, count(*) FILTER (WHERE a = 2) AS n_human_review FROM big_scored""")
def g10(v):
    return rounded(E.evaluate_policy(big_scored(v)))


@query("G11_evaluate_by_class", """
SELECT grade_code, CASE grade_code WHEN 0 THEN 'BenignPositive' WHEN 1 THEN 'FalsePositive' WHEN 2 THEN 'TruePositive' ELSE 'Unknown' END AS grade,
  count(*) AS rows, round(avg(reward), 6) AS average_reward, round(sum(reward) / sum(best), 6) AS class_reward_ratio FROM big_scored GROUP BY 1""")
def g11(v):
    return rounded(E.evaluate_by_class(big_scored(v)))


@query("G10_G11_evaluate_all", """
SELECT grade_code, grouping(grade_code) = 1 AS is_total, count(*) AS rows, CASE WHEN grouping(grade_code) = 1 THEN count(DISTINCT incident_id) END AS incidents,
  sum(reward) AS total_reward, round(avg(reward), 6) AS average_reward, round(avg(best), 6) AS oracle_average_reward, round(sum(reward) / sum(best), 6) AS reward_ratio,
  round(count(*) FILTER (WHERE reward = best) / count(*)::DOUBLE, 6) AS policy_optimality FROM big_scored GROUP BY GROUPING SETS ((grade_code), ())""")
def g10a(v):
    return rounded(E.evaluate_all(big_scored(v)))


@query("G12_action_distribution", """
SELECT ['allow', 'block', 'human_review'][a + 1] AS action, count(*) AS n FROM big_scored GROUP BY 1""")
def g12(v):
    return E.action_distribution(big_scored(v))


@query("G14_reward_regret", "SELECT sum(best - reward) AS regret FROM big_scored")
def g14(v):
    return E.reward_regret(big_scored(v))


@query("G16_sample_metrics", """
SELECT count(*) AS rows, round(avg(reward), 6) AS average_reward, round(sum(reward) / sum(best), 6) AS reward_efficiency,
  count(*) FILTER (WHERE first_action = 0) AS n_allow, count(*) FILTER (WHERE first_action = 1) AS n_block, count(*) FILTER (WHERE first_action = 2) AS n_human_review
FROM (SELECT * FROM scored ORDER BY md5(alert_id), alert_id LIMIT 2000)""")
def g16(v):
    return rounded(E.sample_metrics(scored(v), "alert_id", 2000))


@query("G17_champion", """
WITH c AS (SELECT category, sum(reward) / sum(best) AS ef, count(*) FILTER (WHERE reward = best) / count(*)::DOUBLE AS op FROM scored GROUP BY 1)
SELECT category, round(ef, 6) AS reward_efficiency, round(op, 6) AS policy_optimality, round(0.7e0 * op + 0.3e0 * ef, 6) AS validation_score
FROM c ORDER BY 0.7e0 * op + 0.3e0 * ef DESC, category LIMIT 1""")
def g17(v):
    candidates = scored(v).groupBy("category").agg(
        (F.sum("reward") / F.sum("best")).alias("reward_efficiency"),
        (F.count_if(F.col("reward") == F.col("best")) / F.count(F.lit(1))).alias("policy_optimality"))
    return rounded(E.champion(candidates, "category"))


@query("G18_reward_stats", """
SELECT round(avg(reward), 6) AS mean_reward, max(reward) AS max_reward, min(reward) AS min_reward, count(reward) AS count, sum(reward) AS sum FROM big_scored""")
def g18(v):
    return rounded(E.reward_stats(big_scored(v), "reward"))
