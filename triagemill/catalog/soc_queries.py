"""Operational metrics (H) and the flagship report."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.operators import soc
from triagemill.plans.report import operational_report


def rounded(df, skip=()):
    """Doubles to six decimals, as in the SQL texts."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


TIMED = """SELECT p.*, greatest(0e0, (epoch_us(decided_at) - epoch_us(received)) / 1e6) AS latency,
  greatest(0e0, (epoch_us(coalesce(human_at, decided_at)) - epoch_us(received)) / 1e6) AS response,
  greatest(0e0, (epoch_us(coalesce(analyst_at, decided_at)) - epoch_us(received)) / 1e6) AS response_human
  FROM paired p WHERE received IS NOT NULL AND decided_at IS NOT NULL"""
CONFUSION = """count(*) FILTER (WHERE decided = 'block' AND grade = 'TruePositive') AS tp, count(*) FILTER (WHERE decided = 'block' AND grade <> 'TruePositive') AS fp,
  count(*) FILTER (WHERE decided = 'allow' AND grade = 'TruePositive') AS fn, count(*) FILTER (WHERE decided = 'allow' AND grade <> 'TruePositive') AS tn,
  count(*) FILTER (WHERE decided = 'human_review' AND grade = 'TruePositive') AS abstain_true_positive,
  count(*) FILTER (WHERE decided = 'human_review' AND grade <> 'TruePositive') AS abstain_negative"""
RATES = """round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
  round(2e0 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)), 6) AS f1_score,
  round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_positive_rate, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS false_negative_rate"""


@query("operational_report", f"""
WITH timed AS ({TIMED}), judged AS (SELECT t.*, a.grade FROM timed t LEFT JOIN alerts a USING (alert_id)),
sums AS (SELECT count(*) AS alerts_with_timing, avg(latency) AS ml, quantile_cont(latency, 0.5) AS md, quantile_cont(latency, 0.95) AS p95,
  max(latency) AS mx, avg(response) AS mt, count(*) FILTER (WHERE decided = 'human_review') AS reviewed,
  count(*) FILTER (WHERE decided IN ('allow', 'block')) AS automated, {CONFUSION} FROM judged)
SELECT (SELECT count(*) FROM alerts) AS alerts_total, alerts_with_timing, round(ml, 6) AS mean_latency_s, round(md, 6) AS median_latency_s,
  round(p95, 6) AS p95_latency_s, round(mx, 6) AS max_latency_s, round(mt, 6) AS mttr_s, tp, fp, fn, tn, abstain_true_positive, abstain_negative,
  {RATES}, round(reviewed / (SELECT count(*) FROM alerts)::DOUBLE, 6) AS human_review_rate, round(automated / (SELECT count(*) FROM alerts)::DOUBLE, 6) AS automation_rate
FROM sums""")
def report(v):
    return rounded(operational_report(v.alerts(), v.activity()))


def timed(v, human_only=False):
    return soc.timings(soc.pair_events(v.activity()), human_only)


@query("D8_pair_events", """
SELECT alert_id, epoch_us(received) AS received, epoch_us(decided_at) AS decided_at, decided, epoch_us(human_at) AS human_at, epoch_us(analyst_at) AS analyst_at
FROM paired WHERE received IS NOT NULL AND decided_at IS NOT NULL""")
def d8(v):
    p = soc.pair_events(v.activity())
    return p.select("alert_id", "decided", *[F.unix_micros(c).alias(c) for c in ("received", "decided_at", "human_at", "analyst_at")])


@query("H1_decision_latency", f"""
WITH timed AS ({TIMED}) SELECT count(*) AS count, round(avg(latency), 6) AS mean_seconds, round(median(latency), 6) AS median_seconds,
  round(quantile_cont(latency, 0.95), 6) AS p95_seconds, max(latency) AS max_seconds, min(latency) AS min_seconds, 'available' AS status FROM timed""")
def h1(v):
    return rounded(soc.decision_latency(timed(v)))


@query("H2_mttr", f"WITH timed AS ({TIMED}) SELECT round(avg(response), 6) AS mttr_seconds, count(*) AS alerts FROM timed")
def h2(v):
    return rounded(soc.mttr(timed(v)))


@query("H2_mttr_human_only", f"WITH timed AS ({TIMED}) SELECT round(avg(response_human), 6) AS mttr_seconds, count(*) AS alerts FROM timed")
def h2h(v):
    return rounded(soc.mttr(timed(v, human_only=True)))


def judged(v):
    return soc.with_truth(soc.pair_events(v.activity()), v.alerts())


JUDGED = f"judged AS (SELECT t.*, a.grade FROM ({TIMED}) t LEFT JOIN alerts a USING (alert_id))"


@query("H3_operational_confusion", f"WITH {JUDGED} SELECT {CONFUSION} FROM judged")
def h3(v):
    return soc.operational_confusion(judged(v))


@query("H4_detection_rates", f"""
WITH {JUDGED}, c AS (SELECT {CONFUSION} FROM judged) SELECT tp, fp, fn, tn, abstain_true_positive, abstain_negative, {RATES} FROM c""")
def h4(v):
    return rounded(soc.detection_rates(soc.operational_confusion(judged(v))))


@query("H5_automation_rates", f"""
WITH timed AS ({TIMED}), n AS (SELECT count(*) AS alerts_total FROM alerts)
SELECT alerts_total, count(*) FILTER (WHERE decided = 'human_review') AS reviewed, count(*) FILTER (WHERE decided IN ('allow', 'block')) AS automated,
  round(count(*) FILTER (WHERE decided = 'human_review') / alerts_total::DOUBLE, 6) AS human_review_rate,
  round(count(*) FILTER (WHERE decided IN ('allow', 'block')) / alerts_total::DOUBLE, 6) AS automation_rate FROM timed, n GROUP BY alerts_total""")
def h5(v):
    return rounded(soc.automation_rates(soc.pair_events(v.activity()), v.alerts()))


@query("H6_throughput", f"""
WITH timed AS ({TIMED}), s AS (SELECT count(*) AS alerts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM alerts),
p AS (SELECT quantile_cont(latency, 0.95) AS p95 FROM timed)
SELECT alerts, round(d, 6) AS duration_seconds, round(alerts / d, 6) AS per_second, round(alerts / d * 86400, 6) AS per_day,
  alerts / d >= 10000e0 / 86400 AS meets_10k_per_day, round(p95, 6) AS p95_seconds, p95 < 0.5e0 AS meets_500ms FROM s, p""")
def h6(v):
    return rounded(soc.throughput(v.alerts(), timed(v)))


@query("H7_audit_completeness", """
SELECT count(*) AS total, count(*) FILTER (WHERE mitre IS NOT NULL AND verdict IS NOT NULL AND action_granular IS NOT NULL) AS complete,
  round(count(*) FILTER (WHERE mitre IS NOT NULL AND verdict IS NOT NULL AND action_granular IS NOT NULL) / count(*)::DOUBLE, 6) AS rate FROM alerts""")
def h7(v):
    return rounded(soc.audit_completeness(v.alerts(), ["alert_id", "incident_id", "mitre", "verdict", "action_granular"]))


WORKLOAD = """w AS (SELECT a.analyst_id, a.capacity::BIGINT AS capacity, count(l.alert_id) AS load FROM analysts a LEFT JOIN live_alerts l
  ON l.assigned_analyst = a.analyst_id AND l.status IN ('HUMAN_REVIEW_PENDING', 'ESCALATED', 'OPEN') WHERE a.active GROUP BY 1, 2)"""


@query("D10_workload_join", f"WITH {WORKLOAD} SELECT analyst_id, capacity, load FROM w")
def d10(v):
    return soc.workload_join(v.analysts(), v.live_alerts()).select("analyst_id", "capacity", "load")


@query("H8_analyst_workload", f"""
WITH {WORKLOAD} SELECT analyst_id, capacity, load, greatest(capacity - load, 0) AS available, round(load / capacity::DOUBLE, 6) AS utilization FROM w""")
def h8(v):
    return rounded(soc.analyst_workload(v.analysts(), v.live_alerts()).select("analyst_id", "capacity", "load", "available", "utilization"))


@query("H8_workload_summary", f"""
WITH {WORKLOAD} SELECT round(avg(load), 6) AS average_load, round(var_pop(load), 6) AS load_variance, round(max(load / capacity::DOUBLE), 6) AS maximum_utilization,
  (SELECT analyst_id FROM w ORDER BY load DESC, analyst_id LIMIT 1) AS most_loaded, (SELECT analyst_id FROM w ORDER BY load, analyst_id LIMIT 1) AS least_loaded FROM w""")
def h8s(v):
    return rounded(soc.workload_summary(soc.analyst_workload(v.analysts(), v.live_alerts())))


@query("H9_status_counts", """
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE requires_human_review) AS human_review_pending,
  count(*) FILTER (WHERE agent_status = 'INFERRED') AS agent_decisions FROM live_alerts""")
def h9(v):
    return soc.status_counts(v.live_alerts())


@query("H10_cycle_summary", """
SELECT count(*) FILTER (WHERE mitre IS NOT NULL) AS processed, count(*) FILTER (WHERE mitre IS NOT NULL AND assigned_analyst IS NOT NULL) AS routed,
  count(*) FILTER (WHERE mitre IS NOT NULL AND action_code = 0) AS n_allow, count(*) FILTER (WHERE mitre IS NOT NULL AND action_code = 1) AS n_block,
  count(*) FILTER (WHERE mitre IS NOT NULL AND action_code = 2) AS n_human_review, count(*) FILTER (WHERE mitre IS NULL) AS errors,
  count(*) AS considered, 'completed_with_errors' AS status FROM live_alerts""")
def h10(v):
    from triagemill.functions.rewards import action_name
    live = v.live_alerts().withColumn("action", action_name(F.col("action_code")))
    return soc.cycle_summary(live.filter("mitre is not null"), live.filter("mitre is null"))


@query("H11_metric_or_na", f"""
WITH {JUDGED}, c AS (SELECT {CONFUSION} FROM judged), m AS (SELECT {RATES} FROM c)
SELECT 'precision' AS name, precision AS value, 'available' AS status, CAST(NULL AS VARCHAR) AS reason FROM m
UNION ALL SELECT 'recall', recall, 'available', NULL FROM m
UNION ALL SELECT 'recovery_time', NULL, 'N/A', 'no failure and recovery pair' FROM m""")
def h11(v):
    rates = soc.detection_rates(soc.operational_confusion(judged(v))).select("precision", "recall")
    return rounded(soc.metric_or_na(rates, {"recovery_time": "no failure and recovery pair"}))
