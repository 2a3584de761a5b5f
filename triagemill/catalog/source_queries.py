"""Sources and sinks (S)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.encode_queries import BOOK
from triagemill.catalog.soc_queries import rounded
from triagemill.constants import CATEGORICALS
from triagemill.operators import encode as N
from triagemill.operators import events as EV
from triagemill.operators import quality as Q
from triagemill.operators import splits as SP
from triagemill.session import scratch_path
from triagemill.sources import alerts as SA
from triagemill.sources import sinks as SK
from triagemill.sources.runs import read_run_metrics


@query("S1_read_alerts", """
SELECT incident_id AS "IncidentId", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "Timestamp", category AS "Category", mitre AS "MitreTechniques", grade AS "IncidentGrade",
  action_grouped AS "ActionGrouped", action_granular AS "ActionGranular", entity_type AS "EntityType", evidence_role AS "EvidenceRole", threat_family AS "ThreatFamily",
  os_family AS "OSFamily", suspicion AS "SuspicionLevel", verdict AS "LastVerdict" FROM alerts""")
def s1(v):
    path = scratch_path(v.spark, "raw")
    v.raw_alerts().write.option("header", True).csv(path)
    return SA.read_alerts(v.spark, path)


@query("S2_scan_pruned", "SELECT q0::FLOAT::DOUBLE AS q0, q1::FLOAT::DOUBLE AS q1, incident_id, grade_code FROM alerts")
def s2(v):
    t = SA.scan_pruned(v.alerts(), ["q0", "q1"])
    return t.select(F.col("q0").cast("double").alias("q0"), F.col("q1").cast("double").alias("q1"), "incident_id", "grade_code")


@query("S3_load_contract", """
SELECT count(*) AS rows, count(*) - count(category) AS missing_category, count(*) - count(mitre) AS missing_mitre, count(*) - count(verdict) AS missing_verdict FROM alerts""")
def s3(v):
    a = SA.load_contract(v.alerts(), ["alert_id", "ts", "grade"], ["category", "suspicion"])
    return SA.contract_report(a, ["category", "mitre", "verdict"])


@query("S4_read_run_metrics", """
SELECT run_id::VARCHAR AS run_id, epoch, loss, score AS average_reward, coalesce(CASE WHEN epoch % 2 = 0 THEN value END, score) AS policy_reward, updates, seed, 'dqn' AS algorithm,
  CASE WHEN epoch % 3 = 0 THEN k ELSE updates END AS shown FROM run_history WHERE epoch % 7 <> 0""")
def s4(v):
    path = scratch_path(v.spark, "runs")
    h = v.run_history()
    point = F.struct(
        F.when(F.col("epoch") % 7 != 0, F.col("epoch")).alias("epoch"), "loss", F.col("score").alias("average_reward"),
        F.when(F.col("epoch") % 2 == 0, F.col("value")).alias("policy_reward"), "updates",
        F.when(F.col("epoch") % 3 == 0, F.create_map(F.lit("allow"), F.col("k"))).alias("sample_action_distribution"),
        F.create_map(F.lit("allow"), F.col("updates")).alias("action_counts"))
    # a document holds at most 50 points
    docs = h.groupBy("run_id", F.floor(F.col("epoch") / 50).alias("_part")).agg(
        F.collect_list(point).alias("metrics"), F.max("seed").alias("seed"))
    docs.select(F.struct(F.col("run_id").cast("string").alias("run_id"), F.lit("dqn").alias("algorithm"), "seed").alias("config"), "metrics").write.json(path)
    r = read_run_metrics(v.spark, path, multi_line=False)
    return r.select("run_id", "epoch", "loss", "average_reward", "policy_reward", "updates", "seed", "algorithm",
                    F.element_at("action_distribution", F.lit("allow")).alias("shown"))


@query("S5_write_processed", "SELECT alert_id, category, value FROM train")
def s5(v):
    path = scratch_path(v.spark, "processed")
    SK.write_processed(v.train().select("alert_id", "category", "value"), path)
    return v.spark.read.parquet(path)


@query("S6_codebook_round_trip", BOOK)
def s6(v):
    path = scratch_path(v.spark, "book")
    SK.write_codebook(N.fit_codebook(v.train(), CATEGORICALS), path)
    return SK.read_codebook(v.spark, path)


@query("S7_write_metrics_snapshot", """
SELECT category, count(*) AS n, round(avg(value), 6) AS mean_value, NULL::DOUBLE AS broken FROM alerts GROUP BY 1""")
def s7(v):
    path = scratch_path(v.spark, "metrics")
    m = v.alerts().groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max(F.lit(float("nan"))).alias("broken"))
    SK.write_metrics_snapshot(m.limit(1), path)  # an older snapshot, replaced by the next
    SK.write_metrics_snapshot(m, path)
    return rounded(SK.read_metrics_snapshot(v.spark, path, "category string, n bigint, mean_value double, broken double"))


@query("S8_write_id_sets", """
SELECT DISTINCT incident_id, CASE WHEN ('0x' || substr(md5(concat('4242:', incident_id)), 1, 8))::BIGINT / 4294967296e0 < 0.8e0 THEN 'train' ELSE 'validation' END AS split FROM alerts""")
def s8(v):
    path = scratch_path(v.spark, "ids")
    SK.write_id_sets(SP.incident_split(v.alerts()), path)
    return v.spark.read.parquet(path).select("incident_id", F.col("split").cast("string").alias("split"))


@query("S9_predict_and_write", """
SELECT alert_id, first_action::BIGINT AS action, ['allow', 'block', 'human_review'][first_action + 1] AS action_name, q0 AS q_allow, q1 AS q_block, q2 AS q_human_review FROM soft""")
def s9(v):
    path = scratch_path(v.spark, "predictions")
    SK.predict_and_write(v.alerts().select("alert_id", "q0", "q1", "q2"), lambda df: df, path)
    return v.spark.read.parquet(path).select("alert_id", "action", "action_name", "q_allow", "q_block", "q_human_review")


@query("S10_file_lineage")
def s10(v):
    files = SA.file_lineage(v.spark, {"EVENTS": f"{v.sf_dir}/events.parquet", "LINES": f"{v.sf_dir}/lineitem.parquet", "ABSENT": f"{v.sf_dir}/nothing.parquet"})
    rows = EV.table_counts({"EVENTS": v.table("events"), "LINES": v.table("lineitem")}).withColumnRenamed("table", "role")
    return files.join(rows, "role", "left").select("role", "exists", "files", "bytes", "rows")


@query("S11_append_decisions", """
SELECT alert_id, row_number() OVER (ORDER BY ts, event_id) + (SELECT max(event_id) FROM train) AS id FROM test""")
def s11(v):
    existing = v.train().select(F.col("event_id").alias("id"))
    return EV.append_with_ids(existing, v.test().select("alert_id", "ts", "event_id"), "ts", "event_id").select("alert_id", "id")


@query("S12_table_counts", """
SELECT 'events' AS "table", count(*) AS rows FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders)""")
def s12(v):
    return EV.table_counts({n: v.table(n) for n in ("events", "lineitem", "orders")})


@query("S13_append_pipeline_log", """
SELECT 'train_import' AS type, count(*) AS rows, 3::BIGINT AS columns, count(*) - count(mitre) + count(*) - count(verdict) AS missing, 'events' AS path FROM train""")
def s13(v):
    stats = Q.missing_stats(v.train().select("alert_id", "mitre", "verdict"))
    return EV.pipeline_log_row(stats, "train_import", "events").drop("logged_at")


@query("S14_upsert_dimension", """
SELECT user_id, CASE WHEN bool_or(NOT is_train) THEN 'new' ELSE 'old' END AS state FROM alerts GROUP BY 1""")
def s14(v):
    old = v.train().select("user_id").distinct().withColumn("state", F.lit("old"))
    new = v.test().select("user_id").distinct().withColumn("state", F.lit("new"))
    return EV.upsert_dimension(old, new, "user_id")
