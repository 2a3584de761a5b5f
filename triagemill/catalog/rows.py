"""Row-level cleaning rules (B) over the alert views."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.functions import missing as M
from triagemill.functions import rewards as R
from triagemill.operators import clean as C
from triagemill.plans.views import pick


@query("B1_drop_exact_duplicates", """
SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem""")
def b1(v):
    line = v.table("lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag", "l_linestatus")
    return C.drop_exact_duplicates(line)


@query("B2_fill_unknown", """
SELECT alert_id, category, coalesce(mitre, 'Unknown') AS mitre, coalesce(action_grouped, 'Unknown') AS action_grouped,
  coalesce(action_granular, 'Unknown') AS action_granular, coalesce(verdict, 'Unknown') AS verdict FROM alerts""")
def b2(v):
    names = ["category", "mitre", "action_grouped", "action_granular", "verdict"]
    return C.fill_unknown(v.alerts(), names).select("alert_id", *names)


@query("B3_first_present", """
SELECT alert_id, trim(coalesce(nullif(nullif(nullif(mitre, ''), 'nan'), 'NaN'), nullif(nullif(nullif(verdict, ''), 'nan'), 'NaN'), category)) AS found
FROM (SELECT alert_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'nan' ELSE mitre END AS mitre,
  CASE WHEN k % 7 = 0 THEN 'NaN' ELSE concat(' ', verdict, ' ') END AS verdict, category FROM alerts)""")
def b3(v):
    a = v.alerts().select(
        "alert_id", "category",
        F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "nan").otherwise(F.col("mitre")).alias("mitre"),
        F.when(F.col("k") % 7 == 0, "NaN").otherwise(
            F.concat(F.lit(" "), F.coalesce("verdict", F.lit("")), F.lit(" "))).alias("verdict"))
    return M.first_present(a, "found", ["mitre", "verdict", "absent", "category"], trim=True).select("alert_id", "found")


@query("B4_finite_or_null", """
SELECT event_id, CASE WHEN k % 4 IN (0, 1) THEN NULL ELSE value END AS number,
  CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(k AS DOUBLE) END AS parsed,
  CASE WHEN k % 4 IN (0, 1) THEN 1 ELSE 0 END::BIGINT AS dropped_in_array FROM alerts0""")
def b4(v):
    e = v.alerts().select(
        "event_id",
        F.when(F.col("k") % 4 == 0, F.lit(float("nan"))).when(F.col("k") % 4 == 1, F.lit(float("-inf")))
        .otherwise(F.col("value")).alias("number"),
        F.when(F.col("k") % 4 == 3, F.concat(F.lit("x"), F.col("k").cast("string")))
        .otherwise(F.col("k").cast("string")).alias("parsed"),
    ).withColumn("list", F.array("number", F.lit(1.0)))
    return M.finite_or_null(e, ["number", "parsed", "list"]).select(
        "event_id", "number", "parsed",
        F.size(F.filter("list", lambda x: x.isNull())).cast("long").alias("dropped_in_array"))


@query("B5_parse_event_time", """
SELECT event_id, CASE k % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000000 END AS micros
FROM alerts0""")
def b5(v):
    return M.parse_event_time(v.time_texts(), "stamp", "at").select("event_id", F.unix_micros("at").alias("micros"))


@query("B5_unreadable_times", """
SELECT count(*) FILTER (WHERE k % 4 = 3) AS unreadable, count(*) AS rows FROM alerts0""")
def b5s(v):
    return M.unreadable_times(v.time_texts(), "stamp")


@query("B6_calendar_features", """
SELECT alert_id, hour(ts) AS hour, day(ts) AS day, month(ts) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM alerts""")
def b6(v):
    return M.calendar_features(v.alerts()).select("alert_id", "hour", "day", "month", "is_weekend")


@query("B7_canonical_columns", """
SELECT alert_id, epoch_us(ts) AS micros, k % 3 AS logged_action FROM alerts""")
def b7(v):
    a = v.alerts().select("alert_id", F.col("ts").alias("EventTime"), (F.col("k") % 3).alias("AgentAction"))
    named = C.require_logged_action(C.canonical_columns(a))
    return named.select("alert_id", F.unix_micros("ts").alias("micros"), "logged_action")


@query("B8_observation_columns", """
SELECT alert_id, category, mitre, entity_type, evidence_role, threat_family, os_family, suspicion,
  hour(ts) AS hour, day(ts) AS day, month(ts) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend FROM alerts""")
def b8(v):
    return C.observation_columns(M.calendar_features(v.alerts()), keep=["alert_id"])


@query("B9_leaky_columns", """
SELECT "column", filled, "column" IN ('grade', 'verdict', 'predicted_label') AS by_name, "column" IN ('grade', 'incident_id') AS by_rule
FROM (SELECT unnest(['incident_id', 'category', 'mitre', 'grade', 'verdict', 'predicted_label']) AS "column",
  unnest([count(incident_id), count(category), count(mitre), count(grade), count(verdict), count(*)]) AS filled FROM alerts)""")
def b9(v):
    a = v.alerts().select("incident_id", "category", "mitre", "grade", "verdict",
                          F.col("k").cast("string").alias("predicted_label"))
    return C.leaky_columns(a, "grade", "incident_id")


@query("B10_alert_headline", """
SELECT alert_id, concat(category, ' / ', CASE WHEN k % 9 = 0 THEN 'Unknown' ELSE threat_family END) AS title,
  CASE WHEN k % 8 IN (0, 1) THEN 'medium' ELSE suspicion END AS severity FROM alerts""")
def b10(v):
    a = v.alerts().withColumns({
        "threat_family": F.when(F.col("k") % 9 != 0, F.col("threat_family")),
        "suspicion": F.when(F.col("k") % 8 == 0, "Unknown").when(F.col("k") % 8 != 1, F.col("suspicion"))})
    return C.alert_headline(a).select("alert_id", "title", "severity")


@query("B11_valid_alert_id", "SELECT event_id, CASE WHEN k % 5 = 2 THEN 'nonesuch' ELSE alert_id END AS alert_id FROM alerts WHERE k % 5 NOT IN (0, 1)")
def b11(v):
    a = v.alerts().select("event_id", F.when(F.col("k") % 5 == 0, "  ").when(F.col("k") % 5 == 1, " None ")
                          .when(F.col("k") % 5 == 2, "nonesuch").otherwise(F.col("alert_id")).alias("alert_id"))
    return C.valid_alert_id(a)


@query("B12_search_alerts", """
SELECT alert_id, incident_id, severity FROM live_alerts WHERE lower(severity) = 'high' AND (
  regexp_matches(alert_id, 'cli|t10[0-4]', 'i') OR regexp_matches(incident_id, 'cli|t10[0-4]', 'i') OR regexp_matches(title, 'cli|t10[0-4]', 'i')
  OR regexp_matches(category, 'cli|t10[0-4]', 'i') OR regexp_matches(mitre, 'cli|t10[0-4]', 'i') OR regexp_matches(verdict, 'cli|t10[0-4]', 'i'))""")
def b12(v):
    return C.search_alerts(v.live_alerts(), "CLI|t10[0-4]", "HIGH").select("alert_id", "incident_id", "severity")


@query("B13_decision_text_filter", """
SELECT decision_id, alert_id FROM (SELECT concat('C1:', alert_id) AS decision_id, alert_id, incident_id,
  CASE k % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'human_review' END AS action, verdict FROM alerts)
WHERE contains(lower(concat_ws(' ', decision_id, alert_id, incident_id, action, 'lookup', coalesce(verdict, ''))), 'review lookup mal')""")
def b13(v):
    a = v.alerts().select(F.concat(F.lit("C1:"), "alert_id").alias("decision_id"), "alert_id", "incident_id",
                          pick(F.col("k") % 3, ["allow", "block", "human_review"]).alias("action"),
                          F.lit("lookup").alias("algorithm"), "verdict")
    return C.decision_text_filter(a, " Review LOOKUP mal ").select("decision_id", "alert_id")


@query("B14_review_priority", """
SELECT alert_id, CAST(r AS BIGINT) AS priority_rank, ['HIGH', 'MEDIUM', 'LOW', 'REVIEW'][r + 1] AS priority FROM (
  SELECT alert_id, CASE WHEN grade = 'TruePositive' OR suspicion = 'High' THEN 0
    WHEN grade = 'FalsePositive' OR suspicion = 'Medium' THEN 1 WHEN grade = 'BenignPositive' OR suspicion = 'Low' THEN 2 ELSE 3 END AS r
  FROM (SELECT alert_id, CASE WHEN k % 11 = 0 THEN 'Unknown' ELSE grade END AS grade, CASE WHEN k % 11 = 0 THEN NULL ELSE suspicion END AS suspicion FROM alerts))""")
def b14(v):
    a = v.alerts().withColumns({
        "grade": F.when(F.col("k") % 11 == 0, "Unknown").otherwise(F.col("grade")),
        "suspicion": F.when(F.col("k") % 11 != 0, F.col("suspicion"))})
    return C.review_priority(a).select("alert_id", "priority_rank", "priority")


WORDS = ["approve", "Allowed", " reject", "BLOCK", "deleted", "escalate ", "closed", "maybe"]


@query("B15_normalise_review", """
SELECT event_id, ['APPROVED', 'FINAL_ALLOWED', 'REJECTED', 'FINAL_BLOCKED', 'DELETED', 'ESCALATED', 'CLOSED'][k % 8 + 1] AS status
FROM alerts0 WHERE k % 8 <> 7""")
def b15(v):
    r = v.alerts().select("event_id", pick(F.col("k") % 8, WORDS).alias("decision"))
    return C.normalise_review(r)[0].select("event_id", "status")


@query("B15_rejected_reviews", "SELECT event_id, 'maybe' AS decision FROM alerts0 WHERE k % 8 = 7")
def b15r(v):
    r = v.alerts().select("event_id", pick(F.col("k") % 8, WORDS).alias("decision"))
    return C.normalise_review(r)[1].select("event_id", "decision")


@query("B16_grade_label", """
SELECT alert_id, grade AS grade_name, k % 4 AS code_again, ['allow', 'block', 'human_review'][k % 3 + 1] AS action_name FROM alerts""")
def b16(v):
    from triagemill.constants import GRADES
    return v.alerts().select(
        "alert_id", R.grade_name(F.col("grade_code"), strict=True).alias("grade_name"),
        R.code_of(F.col("grade"), GRADES).alias("code_again"), R.action_name(F.col("k") % 3).alias("action_name"))


@query("B17_unique_key_check", """
SELECT k_id, count(*) AS copies FROM (SELECT CASE WHEN event_id % 100 = 0 THEN NULL WHEN k = 5 THEN concat('user', user_id) ELSE concat('A', event_id) END AS k_id FROM alerts0)
GROUP BY 1 HAVING count(*) > 1 OR k_id IS NULL""")
def b17(v):
    a = v.alerts().select(
        F.when(F.col("event_id") % 100 == 0, F.lit(None)).when(F.col("k") == 5, F.concat(F.lit("user"), F.col("user_id").cast("string")))
        .otherwise(F.col("alert_id")).alias("k_id"))
    return C.unique_key_check(a, "k_id")


@query("B18_expect_count", """
SELECT step::BIGINT AS step, stage, actual, (SELECT count(*) FROM events) AS expected, actual = (SELECT count(*) FROM events) AS matches FROM (
  SELECT 0 AS step, 'source' AS stage, count(*) AS actual FROM alerts UNION ALL
  SELECT 1, 'imported', count(*) FROM activity WHERE action = 'ALERT_IMPORTED' UNION ALL
  SELECT 2, 'processed', count(*) FROM activity WHERE action = 'AGENT_INFERENCE')""")
def b18(v):
    log = v.activity()
    return C.expect_count({
        "source": v.alerts(), "imported": log.filter("action = 'ALERT_IMPORTED'"),
        "processed": log.filter("action = 'AGENT_INFERENCE'")})


@query("B19_round_scores", """
SELECT event_id, round(value / 7e0, 6) AS confidence, round(value / 3e0, 8) AS first_entry FROM alerts0""")
def b19(v):
    a = v.alerts().select("event_id", (F.col("value") / 7).alias("confidence"),
                          F.array(F.col("value") / 3, F.lit(1.0)).alias("state"))
    return C.round_scores(a, "confidence", "state").select("event_id", "confidence", F.get("state", F.lit(0)).alias("first_entry"))


@query("B16_humanize", """
SELECT alert_id, CASE k % 3 WHEN 0 THEN 'Human Review' WHEN 1 THEN 'MODEL ALLOWED' ELSE 'Double Dqn' END AS shown FROM alerts""")
def b16h(v):
    names = ["human_review", "MODEL_ALLOWED", "double-dqn"]
    return v.alerts().select("alert_id", C.humanize(pick(F.col("k") % 3, names)).alias("shown"))
