"""Streams (K): run over the given table with availableNow, checked against batch SQL."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.decide_queries import STAFF, slots, staff
from triagemill.catalog.soc_queries import rounded
from triagemill.plans.views import REQUEST_COMPONENTS, activity_from, alerts_from, requests_from
from triagemill.session import scratch_path
from triagemill.streaming import flows as ST
from triagemill.streaming import liveness as LV


def stream(v, name="events"):
    """The table as a file stream, one file per micro-batch."""
    return (
        v.spark.readStream.schema(v.table(name).schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 1).parquet(v.sf_dir))


@query("K1_ingest_alerts", """
SELECT alert_id, concat(category, ' / ', threat_family) AS title, suspicion AS severity, 'WAITING_INFERENCE' AS status FROM alerts""")
def k1(v):
    twice = F.when(F.col("k") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    arriving = alerts_from(stream(v)).withColumn("copy", F.explode(twice)).withColumn("alert_id", F.concat(F.lit(" "), "alert_id"))
    return ST.drain(ST.ingest_alerts(arriving)).select("alert_id", "title", "severity", "status")


@query("K1_imported_events", "SELECT alert_id, 'ALERT_IMPORTED' AS action, epoch_us(ts) AS micros FROM alerts")
def k1e(v):
    alerts = ST.ingest_alerts(alerts_from(stream(v)))
    return ST.drain(ST.imported_events(alerts)).select("alert_id", "action", F.unix_micros("ts").alias("micros"))


@query("K2_decide_stateless", """
SELECT alert_id, ['allow', 'block', 'human_review'][action_code + 1] AS action, reason AS uncertainty_reason, round(confidence, 6) AS confidence FROM gated""")
def k2s(v):
    scored = alerts_from(stream(v)).withColumn("cycle_id", F.lit("C1"))
    return rounded(ST.drain(ST.decide_stateless(scored).select("alert_id", "action", "uncertainty_reason", "confidence")))


@query("K2_decide_stream", f"""
WITH {STAFF}, {slots("SELECT alert_id, event_id, ts FROM gated WHERE action_code = 2")}
SELECT g.alert_id, ['allow', 'block', 'human_review'][g.action_code + 1] AS action, r.assigned_analyst FROM gated g LEFT JOIN routed r USING (alert_id)""")
def k2(v):
    scored = alerts_from(stream(v)).withColumn("cycle_id", F.lit("C1"))
    return ST.decide_stream(scored, staff(v)).select("alert_id", "action", "assigned_analyst")


@query("K3_current_state_stream", """
SELECT alert_id, arg_max(status, (ts, seq)) AS status, arg_max(analyst, (ts, seq)) AS assigned_analyst, epoch_us(max(ts)) AS updated_at FROM (
  SELECT alert_id, ts, seq, CASE action WHEN 'ALERT_IMPORTED' THEN 'WAITING_INFERENCE' WHEN 'HUMAN_REVIEW_ROUTED' THEN 'HUMAN_REVIEW_PENDING' WHEN 'HUMAN_APPROVED' THEN 'APPROVED'
    WHEN 'AGENT_INFERENCE' THEN CASE decided WHEN 'allow' THEN 'MODEL_ALLOWED' WHEN 'block' THEN 'MODEL_BLOCKED' ELSE 'HUMAN_REVIEW_PENDING' END END AS status,
    CASE WHEN action = 'HUMAN_APPROVED' THEN actor END AS analyst FROM activity) GROUP BY 1""")
def k3s(v):
    events = activity_from(alerts_from(stream(v)))
    state = ST.current_state_stream(events)
    return state.select("alert_id", "status", "assigned_analyst", F.unix_micros("updated_at").alias("updated_at"))


@query("K5_latency_stream", """
SELECT i.alert_id, a.decided, round((epoch_us(a.ts) - epoch_us(i.ts)) / 1e6, 6) AS latency FROM (SELECT * FROM activity WHERE action = 'ALERT_IMPORTED') i
JOIN (SELECT * FROM activity WHERE action = 'AGENT_INFERENCE') a ON a.alert_id = i.alert_id AND a.ts BETWEEN i.ts AND i.ts + INTERVAL 500 MILLISECONDS""")
def k5(v):
    log = activity_from(alerts_from(stream(v)))
    other = activity_from(alerts_from(stream(v)))
    joined = ST.latency_stream(
        log.filter("action = 'ALERT_IMPORTED'"), other.filter("action = 'AGENT_INFERENCE'"), "1 hour", "0.5 SECONDS")
    return rounded(ST.drain(joined))


RATES = """SELECT epoch_us(w) AS window_start, epoch_us(w + INTERVAL {width}) AS window_end, count(*) AS alerts, count(*) FILTER (WHERE decided = 'allow') AS n_allow,
  count(*) FILTER (WHERE decided = 'block') AS n_block, count(*) FILTER (WHERE decided = 'human_review') AS n_human_review,
  round(count(*) FILTER (WHERE decided <> 'human_review') / count(*)::DOUBLE, 6) AS automation_share FROM ({rows}) GROUP BY w"""


@query("K6_tumbling_rates", RATES.format(
    width="1 DAY", rows="SELECT date_trunc('day', ts) AS w, decided FROM activity WHERE action = 'AGENT_INFERENCE'"))
def k6(v):
    log = activity_from(alerts_from(stream(v))).filter("action = 'AGENT_INFERENCE'")
    return rounded(ST.drain(ST.windowed_rates(log, "1 day"), mode="update", keys=["window_start", "window_end"]))


@query("K6_sliding_rates", RATES.format(
    width="12 HOURS", rows="""SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') - d * INTERVAL 6 HOURS AS w, decided
    FROM activity, (SELECT unnest([0, 1]) AS d) WHERE action = 'AGENT_INFERENCE'"""))
def k6s(v):
    log = activity_from(alerts_from(stream(v))).filter("action = 'AGENT_INFERENCE'")
    return rounded(ST.drain(ST.windowed_rates(log, "12 hours", "6 hours"), mode="update", keys=["window_start", "window_end"]))


LIVE = """SELECT c.ordinal::BIGINT AS ordinal, c.component, c.prefix, count(r.event_id) AS request_count,
  round((epoch_us((SELECT max(ts) FROM requests)) - epoch_us(max(r.ts))) / 1e6, 6) AS age_seconds,
  CASE WHEN max(r.ts) IS NULL THEN 'unknown' WHEN (epoch_us((SELECT max(ts) FROM requests)) - epoch_us(max(r.ts))) / 1e6 > 15 THEN 'down' ELSE 'up' END AS status
FROM (VALUES (0, 'clicks_one', '/api/click/1'), (1, 'clicks', '/api/click'), (2, 'views', '/api/view'), (3, 'errors', '/api/error'), (4, 'buys', '/api/purchase'),
  (5, 'joins', '/api/signup'), (6, 'ghost', '/api/ghost')) AS c(ordinal, component, prefix) LEFT JOIN routed_requests r USING (component) GROUP BY 1, 2, 3"""


@query("K7_component_liveness", LIVE)
def k7(v):
    r = v.requests()
    now = r.agg(F.max("ts")).scalar()
    return rounded(ST.component_liveness(ST.component_activity(r, REQUEST_COMPONENTS), REQUEST_COMPONENTS, now))


@query("K7_liveness_stream", LIVE)
def k7s(v):
    seen = ST.drain(ST.component_activity(requests_from(stream(v)), REQUEST_COMPONENTS), mode="update", keys=["component"])
    now = v.requests().agg(F.max("ts")).scalar()
    return rounded(ST.component_liveness(seen, REQUEST_COMPONENTS, now))


@query("K7_liveness_timers", """
SELECT component, count(*) AS request_count, epoch_us(max(ts)) AS last_seen, 'up' AS status FROM routed_requests WHERE component IS NOT NULL GROUP BY 1""")
def k7t(v):
    """The state machine over what is there; no timer runs out meanwhile."""
    path = scratch_path(v.spark, "watched")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    LV.read_through(LV.watch_components(requests_from(stream(v)), REQUEST_COMPONENTS, put, 86_400.0, path=path))
    rows = v.spark.read.schema(f"{LV.CHANGES}, batch int").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    newest = rows.groupBy("component").agg(F.max_by(F.struct("request_count", "last_seen", "status"), "batch").alias("r"))
    return newest.select("component", "r.request_count", F.unix_micros("r.last_seen").alias("last_seen"), "r.status")
