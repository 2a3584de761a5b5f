"""Reward definitions (E) over the alert views."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.functions import rewards as R


def action():
    return F.col("k") % 3


@query("E1_reward_matrix", """
SELECT alert_id, CASE g WHEN 0 THEN 1.5e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN -2e0 ELSE -1e0 END AS r_allow,
  CASE g WHEN 0 THEN -1e0 WHEN 1 THEN -2e0 WHEN 2 THEN 2e0 ELSE 0.5e0 END AS r_block,
  CASE g WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 1e0 ELSE 1.5e0 END AS r_human_review
FROM (SELECT alert_id, CASE WHEN k % 9 = 0 THEN 9 ELSE grade_code END AS g FROM alerts)""")
def e1(v):
    a = v.alerts().withColumn("grade_code", F.when(F.col("k") % 9 == 0, 9).otherwise(F.col("grade_code")))
    return R.reward_matrix(a).select("alert_id", "r_allow", "r_block", "r_human_review")


@query("E2_override_rewards", """
SELECT alert_id, CASE WHEN grade_code = 2 THEN -7.5e0 ELSE r0 END AS r_allow, CASE WHEN grade_code = 0 THEN 0e0 ELSE r1 END AS r_block,
  r2 AS r_human_review FROM rewarded""")
def e2(v):
    table = R.overridden({"TruePositive": {"allow": -7.5, "dance": 3}, "BenignPositive": {"block": 0}, "Nope": {"allow": 1}})
    return R.reward_matrix(v.alerts(), table=table).select("alert_id", "r_allow", "r_block", "r_human_review")


@query("E3_oracle_action", """
SELECT alert_id, greatest(r0, r1, r2) AS best_reward,
  CASE WHEN r0 = greatest(r0, r1, r2) THEN 0 WHEN r1 = greatest(r0, r1, r2) THEN 1 ELSE 2 END::BIGINT AS oracle_action FROM rewarded""")
def e3(v):
    return R.best_reward(R.reward_matrix(v.alerts())).select("alert_id", "best_reward", "oracle_action")


@query("E4_historical_reward", """
SELECT alert_id, CASE
  WHEN grade_code IN (0, 1) AND k % 3 = 0 THEN 8e0 WHEN grade_code = 2 AND k % 3 = 1 THEN 20e0 WHEN grade_code = 3 AND k % 3 = 2 THEN 3e0
  WHEN grade_code = 2 AND k % 3 = 0 THEN -40e0 WHEN grade_code IN (0, 1) AND k % 3 = 1 THEN -15e0 WHEN grade_code = 3 THEN -8e0 ELSE -12e0 END AS reward
FROM alerts""")
def e4(v):
    return v.alerts().select("alert_id", R.historical_reward(F.col("grade_code"), action()).alias("reward"))


@query("E5_feedback_reward", """
SELECT event_id, round(greatest(-50e0, least(50e0, CASE WHEN outcome = 'failed' THEN -20e0 WHEN correct THEN 10e0 WHEN NOT correct THEN -15e0
  WHEN outcome = 'approved' THEN 2e0 WHEN outcome IN ('rejected', 'cancelled') THEN -5e0 ELSE 1e0 END - least(seconds * 0.1e0, 8e0))), 6) AS reward
FROM feedback""")
def e5(v):
    reward = R.feedback_reward(F.col("outcome"), F.col("correct"), F.col("seconds"))
    return v.feedback().select("event_id", F.round(reward, 6).alias("reward"))


LABEL = """CASE WHEN grade = 'TruePositive' THEN CASE k % 3 WHEN 1 THEN 2e0 WHEN 2 THEN 1e0 ELSE -2e0 END
  WHEN grade IN ('FalsePositive', 'BenignPositive') THEN CASE k % 3 WHEN 0 THEN 1.5e0 WHEN 2 THEN 0.25e0 ELSE -2e0 END ELSE 0e0 END"""
FALSE_POSITIVE = """CASE WHEN k % 3 <> 1 THEN 0e0 WHEN coalesce(verdict, 'Unknown') = 'Benign' THEN -15e0 WHEN coalesce(verdict, 'Unknown') = 'Unknown' THEN -2e0
  WHEN suspicion = 'Low' THEN -2e0 WHEN suspicion = 'High' THEN 1e0 ELSE 0e0 END"""
ANALYST = """(CASE suspicion WHEN 'Low' THEN CASE WHEN k % 3 = 0 THEN 4e0 ELSE -4e0 END WHEN 'Medium' THEN CASE WHEN k % 3 = 0 THEN 2e0 ELSE -2e0 END
  ELSE CASE WHEN k % 3 = 1 THEN 4e0 ELSE -4e0 END END
  + CASE WHEN (k % 3 = 1 AND contains(coalesce(action_grouped, ''), 'Escal')) OR (k % 3 = 0 AND (contains(coalesce(action_grouped, ''), 'Close') OR contains(coalesce(action_grouped, ''), 'Ignore'))) THEN 2e0 ELSE 0e0 END
  + CASE WHEN action_granular IS NULL THEN 0e0 WHEN k % 3 = 1 THEN 1e0 ELSE 0.5e0 END)"""
LATENCY = "CASE WHEN processing_s <= 2e0 THEN 0e0 ELSE -least(processing_s * 0.1e0, 8e0) END"


@query("E6_label_reward", f"SELECT alert_id, {LABEL} AS reward FROM alerts")
def e6(v):
    return v.alerts().select("alert_id", R.label_reward(F.col("grade"), action()).alias("reward"))


@query("E7_severity_reward", f"SELECT alert_id, {LABEL} AS reward FROM alerts")
def e7(v):
    label = F.when(F.col("k") % 2 == 0, F.col("grade"))
    return v.alerts().select("alert_id", R.severity_reward(label, F.col("grade_code"), action()).alias("reward"))


@query("E8_false_positive_reward", f"SELECT alert_id, {FALSE_POSITIVE} AS reward FROM alerts")
def e8(v):
    return v.alerts().select("alert_id", R.false_positive_reward(F.col("verdict"), F.col("suspicion"), action()).alias("reward"))


@query("E9_analyst_reward", f"SELECT alert_id, {ANALYST} AS reward FROM alerts".replace("alerts", "alerts_by_action").replace(
    "FROM alerts_by_action", "FROM (SELECT * REPLACE (['Escalated', 'Closed', 'Close', NULL][k // 3 % 4 + 1] AS action_grouped) FROM alerts)"))
def e9(v):
    from triagemill.plans.views import pick
    a = v.alerts().withColumn("action_grouped", pick(F.floor(F.col("k") / 3) % 4, ["Escalated", "Closed", "Close", None]))
    return a.select("alert_id", R.analyst_reward(
        F.col("suspicion"), F.col("action_grouped"), F.col("action_granular"), action()).alias("reward"))


@query("E10_latency_reward", f"SELECT alert_id, round({LATENCY}, 6) AS reward FROM alerts")
def e10(v):
    return v.alerts().select("alert_id", F.round(R.latency_reward(F.col("processing_s")), 6).alias("reward"))


@query("E11_composite_reward", f"""
SELECT alert_id, round(greatest(-50e0, least(50e0, {LABEL} + {FALSE_POSITIVE} + {ANALYST} + {LATENCY})), 6) AS reward FROM alerts""")
def e11(v):
    a = v.alerts().withColumn("act", action())
    return a.select("alert_id", F.round(R.composite_reward(a, "act"), 6).alias("reward"))
