"""Scoring, gating, routing and policies (J)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.soc_queries import rounded
from triagemill.constants import CALENDAR, STATE
from triagemill.functions import scoring as SC
from triagemill.functions.missing import calendar_features
from triagemill.operators import decide as D
from triagemill.operators import encode as N
from triagemill.operators import events as EV
from triagemill.operators import policy as P
from triagemill.operators import soc
from triagemill.plans.views import pick
from triagemill.session import settle

POLICY = """pol AS (SELECT CASE WHEN grouping(category) = 1 THEN 0 WHEN grouping(suspicion) = 1 THEN 1 ELSE 2 END AS level, category, suspicion,
  avg(r0) AS q0, avg(r1) AS q1, avg(r2) AS q2, count(*) AS n FROM rewarded WHERE is_train GROUP BY ROLLUP (category, suspicion)
  HAVING grouping(category) = 1 OR count(*) >= 60)"""
LOOKED = """looked AS (SELECT a.alert_id, a.event_id, a.ts, a.grade_code, a.category, a.suspicion, coalesce(p2.q0, p1.q0, p0.q0) AS q0, coalesce(p2.q1, p1.q1, p0.q1) AS q1, coalesce(p2.q2, p1.q2, p0.q2) AS q2
  FROM test a LEFT JOIN pol p2 ON p2.level = 2 AND p2.category = a.category AND p2.suspicion = a.suspicion
  LEFT JOIN pol p1 ON p1.level = 1 AND p1.category = a.category LEFT JOIN pol p0 ON p0.level = 0)"""
KEYS = ["category", "suspicion"]


@query("J8_fit_action_values", f"""
WITH {POLICY} SELECT level::BIGINT AS level, category, suspicion, round(q0, 6) AS q0, round(q1, 6) AS q1, round(q2, 6) AS q2, n FROM pol""")
def j8(v):
    return rounded(P.fit_action_values(v.train(), KEYS, 60))


@query("J1_score_actions", f"""
WITH {POLICY}, {LOOKED} SELECT alert_id, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END::BIGINT AS action,
  CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'allow' WHEN q1 >= q2 THEN 'block' ELSE 'human_review' END AS action_name,
  round(q0, 6) AS q_allow, round(q1, 6) AS q_block, round(q2, 6) AS q_human_review FROM looked""")
def j1(v):
    policy = P.fit_action_values(v.train(), KEYS, 60)
    out = P.score_actions(P.score_lookup(v.test(), policy, KEYS))
    return rounded(out.select("alert_id", "action", "action_name", "q_allow", "q_block", "q_human_review"))


def coded(v, rows):
    """Rows with the 13 state features as numbers: nine train-only codes and four calendar values."""
    texts = [c for c in STATE if c not in CALENDAR]
    book = v.kept("codebook", lambda: N.fit_codebook(v.train(), texts))
    return N.apply_codebook(calendar_features(rows), book, texts), [f"{c}_code" for c in texts] + CALENDAR


@query("J1_score_network")
def j1c(v):
    import numpy as np
    rng = np.random.default_rng(7)
    rows, names = coded(v, v.test())
    sizes = [len(names), 128, 128, 3]
    layers = [(rng.normal(0, 0.2, (a, b)), rng.normal(0, 0.1, b)) for a, b in zip(sizes, sizes[1:])]
    out = P.score_actions(P.score_network(N.assemble_state(rows, names), layers))
    return out.select("alert_id", "action", "q_allow", "q_block", "q_human_review")


@query("J2_softmax", "SELECT alert_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM soft")
def j2(v):
    p = v.alerts().select("alert_id", SC.softmax(F.array("q0", "q1", "q2")).alias("p"))
    return rounded(p.select("alert_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)]))


@query("J3_gate_decision", """
SELECT alert_id, top_action::BIGINT AS top_action, round(confidence, 6) AS confidence, round(margin, 6) AS action_margin, reason AS uncertainty_reason, action_code::BIGINT AS action_code FROM gated""")
def j3(v):
    return rounded(D.gate_decision(v.alerts()).select(
        "alert_id", "top_action", "confidence", "action_margin", "uncertainty_reason", "action_code"))


@query("J3_first_and_last_maximum", "SELECT alert_id, first_action::BIGINT AS first_action, top_action::BIGINT AS last_action FROM soft")
def j3b(v):
    q = F.array("q0", "q1", "q2")
    return v.alerts().select("alert_id", SC.first_max(q).alias("first_action"), SC.last_max(q).alias("last_action"))


@query("J4_decision_record", """
SELECT alert_id, CASE action_code WHEN 2 THEN 'HUMAN_REVIEW_PENDING' WHEN 0 THEN 'MODEL_ALLOWED' ELSE 'MODEL_BLOCKED' END AS status,
  ['allow', 'block', 'human_review'][action_code + 1] AS action, ['allow', 'block', 'human_review'][top_action + 1] AS model_action, round(q1, 6) AS q_block,
  round(p2, 6) AS p_review, 0.6e0 AS confidence_threshold, 'v1' AS model_version, concat('C', strftime(ts, '%Y%m%d')) AS cycle_id, action_code = 2 AS requires_human_review FROM gated""")
def j4(v):
    cycle = F.concat(F.lit("C"), F.date_format("ts", "yyyyMMdd"))
    r = D.decision_record(D.gate_decision(v.alerts()), "v1", "lookup", cycle)
    return rounded(r.select(
        "alert_id", "status", "action", "model_action", F.col("q_values")["block"].alias("q_block"),
        F.col("action_probabilities")["human_review"].alias("p_review"), "confidence_threshold", "model_version", "cycle_id", "requires_human_review"))


STAFF = """staff AS (SELECT a.analyst_id, a.capacity * 1000 AS cap, count(l.alert_id) AS load FROM analysts a LEFT JOIN live_alerts l
  ON l.assigned_analyst = a.analyst_id AND l.status = 'HUMAN_REVIEW_PENDING' GROUP BY 1, 2)"""


def staff(v):
    w = soc.workload_join(v.analysts(), v.live_alerts())
    return w.withColumn("capacity", F.col("capacity") * 1000)


def slots(reviews):
    return f"""rv AS ({reviews}), n AS (SELECT count(*) AS n FROM rv),
slots AS (SELECT analyst_id, row_number() OVER (ORDER BY kk >= cap, kk, -greatest(cap - kk, 0), analyst_id) AS i FROM (
  SELECT analyst_id, cap, unnest(range(load, load + (SELECT n FROM n))) AS kk FROM staff)),
routed AS (SELECT rv.*, s.analyst_id AS assigned_analyst FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM rv) rv JOIN slots s USING (i))"""


@query("J5_route_to_analysts", f"""
WITH {STAFF}, {slots("SELECT alert_id, event_id, ts FROM gated WHERE action_code = 2")} SELECT alert_id, i - 1 AS "position", assigned_analyst FROM routed""")
def j5(v):
    gated = settle(D.gate_decision(v.alerts()).select("alert_id", "event_id", "ts", "action_code"), "gated")
    reviews = gated.filter("action_code = 2").drop("action_code")
    return D.route_to_analysts(reviews, staff(v)).select("alert_id", "position", "assigned_analyst")


WAITING = """waiting AS (SELECT g.* FROM gated g WHERE event_id % 50 = 0 OR k % 4 = 1)"""
BATCH = f"""{STAFF}, {WAITING}, {slots("SELECT alert_id, event_id, ts, action_code, reason, category FROM waiting WHERE mitre IS NOT NULL AND action_code = 2")},
decided AS (SELECT alert_id, ts, action_code, reason, assigned_analyst FROM routed
  UNION ALL SELECT alert_id, ts, action_code, reason, NULL FROM waiting WHERE mitre IS NOT NULL AND action_code <> 2)"""


def batch(v):
    live = v.live_alerts().withColumn("agent_status", F.when(F.col("k") % 4 != 1, F.col("agent_status")).otherwise(
        F.lit(None).cast("string")))
    return D.decide_batch(live, lambda df: df, staff(v), ["category", "mitre"])


@query("J6_decide_batch", f"""
WITH {BATCH} SELECT alert_id, ['allow', 'block', 'human_review'][action_code + 1] AS action,
  CASE action_code WHEN 2 THEN 'HUMAN_REVIEW_PENDING' WHEN 0 THEN 'MODEL_ALLOWED' ELSE 'MODEL_BLOCKED' END AS status, reason AS uncertainty_reason, assigned_analyst FROM decided""")
def j6(v):
    return batch(v)[0].select("alert_id", "action", "status", "uncertainty_reason", "assigned_analyst")


@query("J6_error_rows", f"WITH {WAITING} SELECT alert_id, 'missing features: mitre' AS error FROM waiting WHERE mitre IS NULL")
def j6e(v):
    return batch(v)[1].select("alert_id", "error")


@query("J7_constrained_action", """
SELECT alert_id, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END::BIGINT AS action FROM (
  SELECT alert_id, CASE WHEN b0 >= t THEN q0 ELSE -1e9 END AS m0, CASE WHEN b1 >= t THEN q1 ELSE -1e9 END AS m1, CASE WHEN b2 >= t THEN q2 ELSE -1e9 END AS m2
  FROM (SELECT *, greatest(b0, b1, b2) * 0.05e0 AS t FROM (SELECT *, (k % 50) / 100e0 AS b0, (event_id % 30) / 100e0 AS b1, 0.2e0 AS b2 FROM alerts)))""")
def j7(v):
    behaviour = F.array((F.col("k") % 50) / 100, (F.col("event_id") % 30) / 100, F.lit(0.2))
    return v.alerts().select("alert_id", SC.constrained_max(F.array("q0", "q1", "q2"), behaviour).alias("action"))


@query("J9_fit_action_values_ml")
def j9(v):
    train, names = coded(v, v.train())
    test, _ = coded(v, v.test())
    model = P.fit_action_values_ml(train, names)
    return P.score_actions(P.score_ml(test, model)).select("alert_id", "action", "q_allow", "q_block", "q_human_review")


@query("J10_grade_baseline")
def j10(v):
    train, names = coded(v, v.train())
    test, _ = coded(v, v.test())
    kept = test.select("alert_id", "grade_code", *names)
    return P.grade_baseline(train, kept, names).select("alert_id", "grade_code", "prediction")


@query("J10_compare_baselines")
def j10c(v):
    """Class-report metrics of the features without and with the calendar ones."""
    train, names = coded(v, v.train())
    test, _ = coded(v, v.test())
    plain = [n for n in names if n not in CALENDAR]
    return P.compare_baselines(train, test, plain, names, trees=10, depth=8)["scores"]


MD5 = "('0x' || substr(md5(concat('{s}:', alert_id)), 1, 8))::BIGINT / 4294967296e0"


@query("J11_epsilon_greedy", f"""
SELECT alert_id, {MD5.format(s='11e')} < e AS explored, (CASE WHEN {MD5.format(s='11e')} < e THEN CAST(floor({MD5.format(s='11a')} * 3) AS BIGINT) ELSE first_action END)::BIGINT AS action
FROM (SELECT *, greatest(0.01e0, pow(0.995e0, event_id)) AS e FROM soft)""")
def j11(v):
    out = D.epsilon_greedy(v.alerts(), D.epsilon_at(F.col("event_id")), 11)
    return out.select("alert_id", "explored", "action")


FP = """fp AS (SELECT sha256(concat_ws(':', count(*), sum(('0x' || substr(d, 1, 8))::BIGINT)::VARCHAR, bit_xor(('0x' || substr(d, 9, 8))::BIGINT), bit_xor(('0x' || substr(d, 17, 8))::BIGINT), '8:category,10:grade_code,11:incident_id,5:mitre')) AS fingerprint,
  count(*) AS rows FROM (SELECT md5(concat(coalesce(length(category) || ':' || category, '~'), coalesce(length(grade_code::VARCHAR) || ':' || grade_code::VARCHAR, '~'), coalesce(length(incident_id) || ':' || incident_id, '~'), coalesce(length(mitre) || ':' || mitre, '~'))) AS d FROM alerts))"""


@query("J12_table_version", f"""
WITH {FP} SELECT 'book' AS name, fingerprint, rows, concat('book-20240201T000000Z-', substr(fingerprint, 1, 10)) AS version, false AS unchanged FROM fp""")
def j12(v):
    t = v.alerts().select("category", "grade_code", "incident_id", "mitre")
    registry = v.spark.sql("SELECT 'book' AS name, 'abc' AS fingerprint, 'book-old' AS version")
    return P.table_version(t, registry, "book", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("J12_unchanged_version", f"WITH {FP} SELECT 'book' AS name, fingerprint, rows, 'book-first' AS version, true AS unchanged FROM fp")
def j12u(v):
    t = v.alerts().select("category", "grade_code", "incident_id", "mitre")
    registry = P.fingerprint(t).select(F.lit("book").alias("name"), "fingerprint", F.lit("book-first").alias("version"))
    return P.table_version(t, registry, "book", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("J13_decision_events", f"""
WITH {BATCH} SELECT alert_id, 1::BIGINT AS seq, 'agent' AS actor, 'AGENT_INFERENCE' AS action, ['allow', 'block', 'human_review'][action_code + 1] AS decided, reason, CAST(NULL AS VARCHAR) AS analyst_id FROM decided
UNION ALL SELECT alert_id, 2, 'system', 'HUMAN_REVIEW_ROUTED', NULL, coalesce(reason, 'MODEL_REQUESTED_REVIEW'), assigned_analyst FROM decided WHERE action_code = 2
UNION ALL SELECT alert_id, 1, 'system', 'AGENT_INFERENCE_ERROR', NULL, 'missing features: mitre', NULL FROM waiting WHERE mitre IS NULL""")
def j13(v):
    decisions, errors = batch(v)
    return D.decision_events(decisions, errors).drop("cycle_id", "ts")


REVIEWS = """rv AS (SELECT CASE WHEN k % 17 = 0 THEN concat('gone-', event_id) ELSE concat('A', event_id - event_id % 3) END AS alert_id, ['SA', 'analyst-01'][event_id % 2 + 1] AS analyst_id,
  ['approve', 'BLOCK', 'assign', 'nonsense'][k % 4 + 1] AS decision, ts, event_id FROM alerts0),
ok AS (SELECT *, CASE k4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'FINAL_BLOCKED' END AS status FROM (SELECT *, CASE decision WHEN 'approve' THEN 0 WHEN 'BLOCK' THEN 1 WHEN 'assign' THEN 2 ELSE 3 END AS k4 FROM rv) WHERE k4 < 3
  AND alert_id IN (SELECT alert_id FROM alerts))"""


def reviews(v):
    k, e = F.col("k"), F.col("event_id")
    return v.alerts().select(
        F.when(k % 17 == 0, F.concat(F.lit("gone-"), e.cast("string"))).otherwise(
            F.concat(F.lit("A"), (e - e % 3).cast("string"))).alias("alert_id"),
        pick(e % 2, ["SA", "analyst-01"]).alias("analyst_id"),
        pick(k % 4, ["approve", "BLOCK", "assign", "nonsense"]).alias("decision"), F.lit("").alias("comment"), "ts",
        e.alias("seq"))


@query("J14_apply_reviews", f"""
WITH {REVIEWS}, last AS (SELECT alert_id, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS new_status, arg_max(analyst_id, (ts, event_id)) AS analyst, bool_or(status IS NOT NULL) AS closed FROM ok GROUP BY 1)
SELECT l.alert_id, coalesce(x.new_status, l.status) AS status, coalesce(x.analyst, l.assigned_analyst) AS assigned_analyst, l.requires_human_review AND NOT coalesce(x.closed, false) AS requires_human_review
FROM live_alerts l LEFT JOIN last x USING (alert_id)""")
def j14(v):
    return EV.apply_reviews(v.live_alerts(), reviews(v))["alerts"].select("alert_id", "status", "assigned_analyst", "requires_human_review")


@query("J14_review_events", f"""
WITH {REVIEWS} SELECT alert_id, event_id AS seq, CASE WHEN status IS NULL THEN 'ASSIGNED' ELSE concat('HUMAN_', status) END AS action,
  CASE WHEN status IS NULL THEN 'SA' ELSE analyst_id END AS actor FROM ok""")
def j14e(v):
    return EV.apply_reviews(v.live_alerts(), reviews(v))["events"].select("alert_id", "seq", "action", "actor")


@query("J14_refused_reviews", f"""
WITH {REVIEWS} SELECT alert_id, event_id AS seq, CASE WHEN decision = 'nonsense' THEN 'unsupported decision' ELSE 'unknown alert' END AS reason FROM rv
WHERE decision = 'nonsense' OR alert_id NOT IN (SELECT alert_id FROM alerts)""")
def j14r(v):
    return EV.apply_reviews(v.live_alerts(), reviews(v))["refused"].select("alert_id", "seq", "reason")
