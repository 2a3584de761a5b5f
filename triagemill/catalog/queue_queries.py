"""Paging, queues and feeds (P)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.operators import events as EV
from triagemill.operators import queues as QU

SHOW = ["alert_id", "severity", "status"]


@query("P1_page_alerts", """
WITH f AS (SELECT * FROM live_alerts WHERE lower(severity) = 'medium' AND (regexp_matches(alert_id, 'err', 'i') OR regexp_matches(incident_id, 'err', 'i')
  OR regexp_matches(title, 'err', 'i') OR regexp_matches(category, 'err', 'i') OR regexp_matches(mitre, 'err', 'i') OR regexp_matches(verdict, 'err', 'i')))
SELECT alert_id, severity, status, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20""")
def p1(v):
    return QU.page_alerts(v.live_alerts(), "err", "MEDIUM", 20, 50).select(*SHOW, "total")


@query("P2_review_queue", """
SELECT alert_id, severity, status FROM (SELECT * FROM live_alerts ORDER BY ts DESC, event_id DESC LIMIT 300) WHERE requires_human_review""")
def p2(v):
    return QU.review_queue(v.live_alerts(), 300).select(*SHOW)


@query("P2_review_queue_filter_first", """
SELECT alert_id, severity, status FROM live_alerts WHERE requires_human_review ORDER BY ts DESC, event_id DESC LIMIT 300""")
def p2f(v):
    return QU.review_queue(v.live_alerts(), 300, filter_first=True).select(*SHOW)


@query("P3_pending_for_analyst", """
SELECT alert_id, severity, status FROM (SELECT * FROM live_alerts ORDER BY ts DESC, event_id DESC LIMIT 400)
WHERE requires_human_review AND status IN ('HUMAN_REVIEW_PENDING', 'ESCALATED', 'OPEN') AND assigned_analyst = 'SA'""")
def p3(v):
    return QU.pending_for_analyst(v.live_alerts(), "SA", 400).select(*SHOW)


@query("P4_prioritised_queue", """
WITH q AS (SELECT *, CASE WHEN grade = 'TruePositive' OR suspicion = 'High' THEN 0 WHEN grade = 'FalsePositive' OR suspicion = 'Medium' THEN 1 ELSE 2 END AS r FROM live_alerts WHERE requires_human_review)
SELECT alert_id, r::BIGINT AS priority_rank, (SELECT ceil(count(*) / 25e0)::BIGINT FROM q) AS total_pages, 51::BIGINT AS page_start, least(75, (SELECT count(*) FROM q)) AS page_end
FROM q ORDER BY r, ts DESC, event_id DESC LIMIT 25 OFFSET 50""")
def p4(v):
    pending = v.live_alerts().filter("requires_human_review")
    return QU.prioritised_queue(pending, 3, 25).select("alert_id", "priority_rank", "total_pages", "page_start", "page_end")


@query("P5_alert_history", """
SELECT alert_id, seq::BIGINT AS seq, action FROM activity QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, seq DESC) <= 2""")
def p5(v):
    return QU.alert_history(v.activity(), 2).select("alert_id", "seq", "action")


@query("P6_activity_feed", "SELECT alert_id, seq::BIGINT AS seq, action, epoch_us(ts) AS micros FROM activity ORDER BY ts DESC, event_id DESC, seq DESC LIMIT 200")
def p6(v):
    return QU.activity_feed(v.activity(), 200).select("alert_id", "seq", "action", F.unix_micros("ts").alias("micros"))


@query("P7_analyst_actions", """
SELECT alert_id, action, actor FROM (SELECT * FROM activity WHERE actor <> 'system' ORDER BY ts DESC, event_id DESC, seq DESC LIMIT 300) WHERE starts_with(action, 'HUMAN_') OR starts_with(action, 'ASSIGNED')""")
def p7(v):
    return QU.analyst_actions(v.activity(), n=300).select("alert_id", "action", "actor")


@query("P7_one_analyst", """
SELECT alert_id, action, actor FROM activity WHERE actor = 'analyst-02' AND starts_with(action, 'HUMAN_') ORDER BY ts DESC, event_id DESC, seq DESC LIMIT 100""")
def p7o(v):
    return QU.analyst_actions(v.activity(), "analyst-02", 100).select("alert_id", "action", "actor")


@query("P8_latest_cycle_decisions", """
WITH c AS (SELECT arg_max(cycle_id, (ts, event_id)) AS cycle_id FROM activity WHERE action = 'AGENT_INFERENCE'),
d AS (SELECT * FROM activity WHERE action = 'AGENT_INFERENCE' AND cycle_id = (SELECT cycle_id FROM c) ORDER BY ts DESC, event_id DESC, seq DESC LIMIT 100)
SELECT concat(d.cycle_id, ':', d.alert_id) AS decision_id, d.alert_id, d.decided AS action, l.incident_id, l.status, l.assigned_analyst, l.category, l.verdict
FROM d LEFT JOIN live_alerts l USING (alert_id)""")
def p8(v):
    out = QU.latest_cycle_decisions(v.activity(), v.live_alerts(), 100)
    return out.select("decision_id", "alert_id", F.col("decided").alias("action"), "incident_id", "status", "assigned_analyst", "category", "verdict")


@query("P9_cycle_history", """
SELECT cycle_id, count(*) FILTER (WHERE action = 'ALERT_IMPORTED') AS alert_count, count(*) AS activity_count, count(*) FILTER (WHERE seq = 3) AS review_count
FROM activity GROUP BY 1 ORDER BY max(ts) DESC, cycle_id DESC LIMIT 20""")
def p9(v):
    log = v.activity()
    cycles = EV.cycle_counts(
        log.filter("action = 'ALERT_IMPORTED'"), log.filter("seq = 3"), log)
    times = log.groupBy("cycle_id").agg(F.max("ts").alias("archived_at"))
    return QU.cycle_history(cycles.join(times, "cycle_id"), 20).select("cycle_id", "alert_count", "activity_count", "review_count")


@query("K4_archive_cycle", """
SELECT c.cycle_id, c.n AS alert_count, coalesce(r.n, 0) AS review_count, a.n AS activity_count FROM (SELECT concat('C', strftime(ts, '%Y%m%d')) AS cycle_id, count(*) AS n FROM alerts GROUP BY 1) c
LEFT JOIN (SELECT cycle_id, count(*) AS n FROM activity WHERE seq = 3 GROUP BY 1) r USING (cycle_id) LEFT JOIN (SELECT cycle_id, count(*) AS n FROM activity GROUP BY 1) a USING (cycle_id)""")
def k4(v):
    from triagemill.session import scratch_path
    log = v.activity()
    alerts = v.live_alerts().select("alert_id", "cycle_id", "status")
    return EV.archive_cycle(alerts, log.filter("seq = 3"), log, scratch_path(v.spark, "archive"))


@query("K4_start_cycle", """
SELECT alert_id, 'NEW' AS cycle_id, 'WAITING_INFERENCE' AS status, 'WAITING_INFERENCE' AS agent_status, 'manual_refresh' AS cycle_reason FROM alerts""")
def k4s(v):
    fresh = EV.start_cycle(v.alerts().select("alert_id"), "NEW", "manual_refresh")
    return fresh.select("alert_id", "cycle_id", "status", "agent_status", "cycle_reason")


@query("K3_current_alert_state", """
SELECT alert_id, arg_max(status, (ts, seq)) AS status, arg_max(analyst, (ts, seq)) AS assigned_analyst, arg_max(human, (ts, seq)) AS last_human_decision, epoch_us(max(ts)) AS updated_at FROM (
  SELECT alert_id, ts, seq, CASE action WHEN 'ALERT_IMPORTED' THEN 'WAITING_INFERENCE' WHEN 'HUMAN_REVIEW_ROUTED' THEN 'HUMAN_REVIEW_PENDING' WHEN 'HUMAN_APPROVED' THEN 'APPROVED'
    WHEN 'AGENT_INFERENCE' THEN CASE decided WHEN 'allow' THEN 'MODEL_ALLOWED' WHEN 'block' THEN 'MODEL_BLOCKED' ELSE 'HUMAN_REVIEW_PENDING' END END AS status,
    CASE WHEN action = 'HUMAN_APPROVED' THEN actor END AS analyst, CASE WHEN action = 'HUMAN_APPROVED' THEN 'APPROVED' END AS human FROM activity) GROUP BY 1""")
def k3(v):
    s = EV.current_alert_state(v.activity())
    return s.select("alert_id", "status", "assigned_analyst", "last_human_decision", F.unix_micros("updated_at").alias("updated_at"))
