"""Registry of queries and the SQL texts they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagemill.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name`` with its SQL counterpart."""

    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return keep


PICK_ANALYST4 = "(['SA','analyst-01','analyst-02','analyst-03'])"

VIEW_SQL = {
    "alerts0": """
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "alerts": """
  SELECT concat('A', event_id) AS alert_id, event_id,
    concat(user_id, '-', strftime(ts, '%Y-%m-%d')) AS incident_id, user_id, ts, k, value,
    event_type AS category,
    CASE WHEN k % 10 <> 0 THEN concat('T', k + 1000) END AS mitre,
    k % 4 AS grade_code,
    CASE k % 4 WHEN 0 THEN 'BenignPositive' WHEN 1 THEN 'FalsePositive' WHEN 2 THEN 'TruePositive' ELSE 'Unknown' END AS grade,
    CASE k % 3 WHEN 0 THEN 'Escalated' WHEN 1 THEN 'Closed' END AS action_grouped,
    CASE WHEN k % 5 <> 0 THEN concat('act', k % 5) END AS action_granular,
    concat('E', user_id % 28) AS entity_type,
    CASE WHEN event_id % 2 = 0 THEN 'Related' ELSE 'Impacted' END AS evidence_role,
    concat(user_id, ':', k) AS threat_family,
    concat('OS', user_id % 4) AS os_family,
    CASE WHEN value < 20 THEN 'Low' WHEN value < 60 THEN 'Medium' ELSE 'High' END AS suspicion,
    CASE k % 6 WHEN 0 THEN 'Benign' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Malicious' WHEN 3 THEN 'Suspicious' WHEN 5 THEN 'NoThreats' END AS verdict,
    value / 10e0 AS processing_s,
    CAST((event_id * 7 + k) % 100 AS DOUBLE) / 50e0 - 1e0 AS q0,
    CAST((event_id * 13 + k) % 100 AS DOUBLE) / 50e0 - 1e0 AS q1,
    CAST((event_id * 29 + k) % 100 AS DOUBLE) / 50e0 - 1e0 AS q2,
    ts < TIMESTAMP '2024-01-21' AS is_train
  FROM alerts0""",
    "train": "SELECT * FROM alerts WHERE is_train",
    "test": "SELECT * FROM alerts WHERE NOT is_train",
    "rewarded": """
  SELECT *,
    CASE grade_code WHEN 0 THEN 1.5e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN -2e0 ELSE -1e0 END AS r0,
    CASE grade_code WHEN 0 THEN -1e0 WHEN 1 THEN -2e0 WHEN 2 THEN 2e0 ELSE 0.5e0 END AS r1,
    CASE grade_code WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 1e0 ELSE 1.5e0 END AS r2
  FROM alerts""",
    "soft0": """
  SELECT *, greatest(q0, q1, q2) AS qm,
    exp(greatest(q0 - greatest(q0, q1, q2), -50e0)) AS e0,
    exp(greatest(q1 - greatest(q0, q1, q2), -50e0)) AS e1,
    exp(greatest(q2 - greatest(q0, q1, q2), -50e0)) AS e2
  FROM rewarded""",
    "soft": """
  SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2,
    CASE WHEN q2 = qm THEN 2 WHEN q1 = qm THEN 1 ELSE 0 END AS top_action,
    CASE WHEN q0 = qm THEN 0 WHEN q1 = qm THEN 1 ELSE 2 END AS first_action
  FROM soft0""",
    "gate0": """
  SELECT *, greatest(p0, p1, p2) AS confidence,
    greatest(p0, p1, p2) - list_sort([p0, p1, p2])[2] AS margin
  FROM soft""",
    "gated": """
  SELECT *,
    CASE WHEN top_action = 2 THEN NULL WHEN confidence < 0.6e0 THEN 'LOW_CONFIDENCE'
         WHEN margin < 0.15e0 THEN 'LOW_MARGIN' END AS reason,
    CASE WHEN top_action = 2 OR confidence < 0.6e0 OR margin < 0.15e0 THEN 2 ELSE top_action END AS action_code
  FROM gate0""",
    "scored": """
  SELECT *, CASE first_action WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS reward,
    greatest(r0, r1, r2) AS best FROM soft""",
    "activity": """
  SELECT alert_id, event_id, concat('C', strftime(ts, '%Y%m%d')) AS cycle_id, 0 AS seq, 'ALERT_IMPORTED' AS action,
    'system' AS actor, ts, CAST(NULL AS VARCHAR) AS decided FROM gated
  UNION ALL
  SELECT alert_id, event_id, concat('C', strftime(ts, '%Y%m%d')), 1, 'AGENT_INFERENCE', 'agent', ts + to_milliseconds(k * 10),
    ['allow', 'block', 'human_review'][action_code + 1] FROM gated WHERE event_id % 50 <> 0
  UNION ALL
  SELECT alert_id, event_id, concat('C', strftime(ts, '%Y%m%d')), 2, 'HUMAN_REVIEW_ROUTED', 'system', ts + to_milliseconds(k * 10),
    NULL FROM gated WHERE event_id % 50 <> 0 AND action_code = 2
  UNION ALL
  SELECT alert_id, event_id, concat('C', strftime(ts, '%Y%m%d')), 3, 'HUMAN_APPROVED',
    ['SA', 'analyst-01', 'analyst-02', 'analyst-03'][(event_id + k) % 4 + 1],
    ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT)), NULL FROM gated WHERE k % 7 = 0""",
    "live_alerts": """
  SELECT *,
    CASE WHEN event_id % 50 = 0 THEN 'WAITING_INFERENCE'
         WHEN action_code = 2 AND k % 7 = 0 THEN 'APPROVED'
         WHEN action_code = 2 THEN 'HUMAN_REVIEW_PENDING'
         WHEN action_code = 1 THEN 'MODEL_BLOCKED' ELSE 'MODEL_ALLOWED' END AS status,
    CASE WHEN event_id % 50 = 0 THEN 'WAITING_INFERENCE' ELSE 'INFERRED' END AS agent_status,
    (event_id % 50 <> 0 AND action_code = 2 AND k % 7 <> 0) AS requires_human_review,
    CASE WHEN event_id % 50 <> 0 AND action_code = 2
         THEN ['SA', 'analyst-01', 'analyst-02', 'analyst-03', NULL][(event_id + k) % 5 + 1] END AS assigned_analyst,
    suspicion AS severity, concat(category, ' / ', threat_family) AS title,
    concat('C', strftime(ts, '%Y%m%d')) AS cycle_id
  FROM gated""",
    "analysts": """
  SELECT * FROM (VALUES ('SA', 'SOC Analyst', 'Supervision', 10, true), ('analyst-01', 'Analyst 01', 'Tier 1', 10, true),
    ('analyst-02', 'Analyst 02', 'Tier 1', 10, true), ('analyst-03', 'Analyst 03', 'Tier 2', 8, true))
    AS t(analyst_id, name, role, capacity, active)""",
    "run_history": """
  SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
    value / 1000e0 AS score, 1e0 / (1 + row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS loss,
    event_type AS action, user_id % 5 AS seed, k + 1 AS updates, value, k, ts
  FROM alerts0""",
    "requests": """
  SELECT event_id, concat('/api/', event_type, '/', k) AS path, ts FROM alerts0""",
    "routed_requests": """
  SELECT *, CASE WHEN starts_with(path, '/api/click/1') THEN 'clicks_one' WHEN starts_with(path, '/api/click') THEN 'clicks'
    WHEN starts_with(path, '/api/view') THEN 'views' WHEN starts_with(path, '/api/error') THEN 'errors'
    WHEN starts_with(path, '/api/purchase') THEN 'buys' WHEN starts_with(path, '/api/signup') THEN 'joins'
    WHEN starts_with(path, '/api/ghost') THEN 'ghost' END AS component FROM requests""",
    "feedback": """
  SELECT event_id, ['failed', 'approved', 'rejected', 'cancelled', 'executed'][k % 5 + 1] AS outcome,
    [true, false, NULL][event_id % 3 + 1] AS correct, value AS seconds FROM alerts0""",
    "time_texts": """
  SELECT event_id, CASE k % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) ELSE concat('bad-', k) END AS stamp FROM alerts0""",
    "alerts_big": """
  SELECT l_orderkey AS incident_id, l_returnflag AS category, (l_linenumber + l_suppkey) % 4 AS grade_code,
    l_shipdate AS ts, l_linestatus AS os_family, l_quantity AS value,
    CAST((l_orderkey * 7 + l_suppkey) % 100 AS DOUBLE) / 50e0 - 1e0 AS q0,
    CAST((l_orderkey * 13 + l_suppkey) % 100 AS DOUBLE) / 50e0 - 1e0 AS q1,
    CAST((l_orderkey * 29 + l_suppkey) % 100 AS DOUBLE) / 50e0 - 1e0 AS q2
  FROM lineitem""",
    "big_scored": """
  SELECT *, CASE a WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS reward, greatest(r0, r1, r2) AS best FROM (
    SELECT *, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS a,
      CASE grade_code WHEN 0 THEN 1.5e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN -2e0 ELSE -1e0 END AS r0,
      CASE grade_code WHEN 0 THEN -1e0 WHEN 1 THEN -2e0 WHEN 2 THEN 2e0 ELSE 0.5e0 END AS r1,
      CASE grade_code WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 1e0 ELSE 1.5e0 END AS r2
    FROM alerts_big)""",
    "paired": """
  SELECT alert_id, min(ts) FILTER (WHERE action = 'ALERT_IMPORTED') AS received,
    min(ts) FILTER (WHERE action = 'AGENT_INFERENCE') AS decided_at,
    min(decided) FILTER (WHERE action = 'AGENT_INFERENCE') AS decided,
    min(ts) FILTER (WHERE action LIKE 'HUMAN\\_%' ESCAPE '\\') AS human_at,
    min(ts) FILTER (WHERE action LIKE 'HUMAN\\_%' ESCAPE '\\' AND actor <> 'system') AS analyst_at
  FROM activity GROUP BY alert_id""",
}


def with_views(sql: str) -> str:
    """Prepend the view definitions a text uses, in dependency order."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in needed]
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body.split(None, 2)[2]
    if re.match(r"WITH\s", body, re.I):
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(parts) + "\n" + body
