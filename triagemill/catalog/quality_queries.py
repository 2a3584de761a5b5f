"""Data quality and screening (G1-G9), split statistics."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.soc_queries import rounded
from triagemill.operators import quality as Q

NAMES = ["category", "mitre", "action_grouped", "grade", "verdict", "suspicion"]


@query("G1_audit_split", """
SELECT sum(c)::BIGINT AS rows, 6::BIGINT AS columns, sum(c * m)::BIGINT AS missing, sum(c - 1)::BIGINT AS duplicates FROM (
  SELECT count(*) AS c, any_value((mitre IS NULL)::INT + (action_grouped IS NULL)::INT + (verdict IS NULL)::INT) AS m
  FROM alerts GROUP BY category, mitre, action_grouped, grade, verdict, suspicion)""")
def g1(v):
    return Q.audit_split(v.alerts().select(*NAMES))


@query("G1_class_distribution", "SELECT grade_code, count(*) AS rows FROM alerts_big GROUP BY 1")
def g1c(v):
    return Q.class_counts(v.alerts_big(), "grade_code")


@query("G2_pipeline_stats", """
WITH s AS (SELECT is_train, count(*) AS rows, sum((mitre IS NULL)::INT + (action_grouped IS NULL)::INT + (verdict IS NULL)::INT)::BIGINT AS missing FROM alerts GROUP BY 1)
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, rows, 6::BIGINT AS columns, missing FROM s
UNION ALL SELECT 'total', sum(rows)::BIGINT, 6, sum(missing)::BIGINT FROM s""")
def g2(v):
    return Q.pipeline_stats(v.train().select(*NAMES), v.test().select(*NAMES))


@query("G3_target_distribution", """
SELECT g AS verdict, count(*) AS rows, round(count(*) * 100e0 / (SELECT count(*) FROM alerts), 6) AS percent FROM (SELECT verdict AS g FROM alerts) GROUP BY 1""")
def g3(v):
    return rounded(Q.target_distribution(v.alerts(), "verdict"))


HEALTH_TEXT = """SELECT '{c}' AS "column", 'string' AS dtype, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS "unique", count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100e0 / count(*), 6) AS missing_pct, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  {role} AS forbidden_role, {name} AS forbidden_name FROM alerts"""
HEALTH_NUM = """SELECT '{c}', '{t}', count(DISTINCT {c}) + max(({c} IS NULL)::INT), count(*) - count({c}), round((count(*) - count({c})) * 100e0 / count(*), 6),
  round(avg({c}), 6), round(stddev_samp({c}), 6), round(min({c}), 6)::DOUBLE, round(max({c}), 6)::DOUBLE, {role}, {name} FROM alerts"""


@query("G4_feature_health", " UNION ALL ".join(
    [HEALTH_TEXT.format(c=c, role=str(c in ("grade", "incident_id")).lower(), name=str(c in ("grade", "verdict")).lower())
     for c in ("incident_id", "category", "mitre", "verdict", "threat_family", "grade")]
    + [HEALTH_NUM.format(c=c, t=t, role="false", name="false") for c, t in (("value", "double"), ("k", "bigint"))]))
def g4(v):
    a = v.alerts().select("incident_id", "category", "mitre", "verdict", "threat_family", "grade", "value", "k")
    return rounded(Q.feature_health(a, ["grade", "incident_id"]))


SCREEN = ["category", "mitre", "verdict", "suspicion", "action_granular", "threat_family"]
GAIN = """SELECT '{c}' AS "column", round((SELECT -sum(p * log2(p + 1e-12)) FROM (SELECT count(*) / (SELECT count(*) FROM alerts)::DOUBLE AS p FROM alerts GROUP BY grade))
  - (SELECT sum(nv / (SELECT count(*) FROM alerts)::DOUBLE * h) FROM (SELECT v, sum(n) AS nv, -sum(n / nt * log2(n / nt + 1e-12)) AS h FROM (
      SELECT {c} AS v, grade, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {c})::DOUBLE AS nt FROM alerts GROUP BY 1, 2) GROUP BY v)), 6) AS information_gain,
  (SELECT count(*) FROM (SELECT DISTINCT {c} FROM alerts)) AS "unique" """


@query("G5_information_gain", " UNION ALL ".join(GAIN.format(c=c) for c in SCREEN))
def g5(v):
    return rounded(Q.information_gain(v.alerts().select(*SCREEN, "grade"), SCREEN, "grade"))


@query("G6_select_features", f"""
WITH g AS ({" UNION ALL ".join(GAIN.format(c=c) for c in ("action_grouped", "action_granular", "evidence_role", "q0"))}),
r AS (SELECT "column", row_number() OVER (ORDER BY information_gain DESC, "column") AS n FROM g WHERE "column" <> 'evidence_role')
SELECT 'category' AS "column", 1::BIGINT AS "position", true AS is_base UNION ALL SELECT 'evidence_role', 2, true
UNION ALL SELECT "column", n + 2, false FROM r WHERE n <= 2""")
def g6(v):
    a = v.alerts().select("incident_id", "category", "evidence_role", "verdict", "action_grouped", "action_granular", "q0", "grade",
                          F.lit("same").alias("constant"), F.when(F.col("k") < 40, F.col("k")).alias("mostly_missing"))
    return Q.select_features(a, "grade", "incident_id", k=2, base=["category", "evidence_role"])


PRED = "(SELECT grade_code AS y, CASE WHEN k % 7 < 3 THEN grade_code ELSE (event_id + k) % 4 END AS p FROM alerts)"
PER = f"""per AS (SELECT c AS label, count(*) FILTER (WHERE y = c AND p = c)::DOUBLE AS tp, count(*) FILTER (WHERE p = c)::DOUBLE AS np, count(*) FILTER (WHERE y = c)::DOUBLE AS s
  FROM {PRED}, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY c),
prf AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS pr, CASE WHEN s = 0 THEN 0 ELSE tp / s END AS re FROM per),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM prf)"""


def predictions(v):
    guess = F.when(F.col("k") % 7 < 3, F.col("grade_code")).otherwise((F.col("event_id") + F.col("k")) % 4)
    return v.alerts().select(F.col("grade_code").alias("y"), guess.alias("p"), "event_id")


@query("G7_classification_report", f"""
WITH {PER} SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(avg(re), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(pr * s) / sum(s), 6) AS weighted_precision, round(sum(re * s) / sum(s), 6) AS weighted_recall, round(sum(f1 * s) / sum(s), 6) AS weighted_f1,
  round(max(re) FILTER (WHERE label = 2), 6) AS true_positive_recall, round(max(f1) FILTER (WHERE label = 3), 6) AS unknown_f1, sum(s)::BIGINT AS support FROM f""")
def g7(v):
    return rounded(Q.classification_report(predictions(v), "y", "p"))


@query("G7_class_report", f"""
WITH {PER} SELECT label::BIGINT AS label, tp::BIGINT AS tp, np::BIGINT AS predicted, s::BIGINT AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def g7c(v):
    return rounded(Q.class_report(predictions(v), "y", "p"))


@query("G7_confusion_matrix", f"""
SELECT y AS label, count(*) FILTER (WHERE p = 0) AS pred_0, count(*) FILTER (WHERE p = 1) AS pred_1, count(*) FILTER (WHERE p = 2) AS pred_2, count(*) FILTER (WHERE p = 3) AS pred_3
FROM {PRED} GROUP BY y""")
def g7m(v):
    return Q.confusion_matrix(predictions(v), "y", "p")


@query("G8_binary_confusion", """
SELECT count(*) FILTER (WHERE quality = toxic AND quality = 1) AS tp, count(*) FILTER (WHERE quality = toxic AND quality <> 1) AS tn,
  count(*) FILTER (WHERE quality <> toxic AND quality = 1) AS fp, count(*) FILTER (WHERE quality <> toxic AND quality <> 1) AS fn FROM labels""")
def g8(v):
    return Q.binary_confusion(v.table("labels"), "quality", "toxic")


@query("G9_quality_gate", f"""
WITH {PER}, cur AS (SELECT avg(f1) AS m, max(re) FILTER (WHERE label = 2) AS t, max(f1) FILTER (WHERE label = 3) AS u FROM f),
per2 AS (SELECT c AS label, count(*) FILTER (WHERE y = c AND p = c)::DOUBLE AS tp, count(*) FILTER (WHERE p = c)::DOUBLE AS np, count(*) FILTER (WHERE y = c)::DOUBLE AS s
  FROM (SELECT grade_code AS y, CASE WHEN k % 7 < 5 THEN grade_code ELSE (event_id + k) % 4 END AS p FROM alerts), (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY c),
f2 AS (SELECT label, tp / s AS re, 2 * (tp / np) * (tp / s) / (tp / np + tp / s) AS f1 FROM per2),
exp AS (SELECT avg(f1) AS m, max(re) FILTER (WHERE label = 2) AS t, max(f1) FILTER (WHERE label = 3) AS u FROM f2),
o AS (SELECT count(*) AS n FROM (SELECT user_id FROM train INTERSECT SELECT user_id FROM test))
SELECT round(exp.m - cur.m, 6) AS macro_f1_change, round(exp.t - cur.t, 6) AS tp_recall_change, round(exp.u - cur.u, 6) AS unknown_f1_change,
  n = 0 AS zero_overlap, exp.m >= cur.m + 0.03e0 AS macro_f1_ok, exp.t >= cur.t + 0.1e0 AS tp_recall_ok, exp.u >= greatest(0.05e0, cur.u - 0.02e0) AS unknown_ok,
  n = 0 AND exp.m >= cur.m + 0.03e0 AND exp.t >= cur.t + 0.1e0 AND exp.u >= greatest(0.05e0, cur.u - 0.02e0) AS passed FROM cur, exp, o""")
def g9(v):
    better = F.when(F.col("k") % 7 < 5, F.col("grade_code")).otherwise((F.col("event_id") + F.col("k")) % 4)
    expanded = v.alerts().select(F.col("grade_code").alias("y"), better.alias("p"))
    leaky = v.alerts_leaky()
    shared = leaky.filter("is_train").select("incident_id").intersect(leaky.filter("not is_train").select("incident_id"))
    return rounded(Q.quality_gate(
        Q.classification_report(predictions(v), "y", "p"), Q.classification_report(expanded, "y", "p"),
        shared.agg(F.count(F.lit(1))).scalar()))
