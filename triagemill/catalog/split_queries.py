"""Splits, overlaps and joins (D, C4, C5)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.operators import encode as N
from triagemill.operators import joins as J
from triagemill.operators import splits as SP
from triagemill.plans.views import REQUEST_COMPONENTS

HASH = "('0x' || substr(md5(concat('4242:', {0})), 1, 8))::BIGINT / 4294967296e0"


@query("D1_distinct_ids", "SELECT DISTINCT l_orderkey::VARCHAR AS incident_id FROM lineitem")
def d1(v):
    return SP.distinct_ids(v.alerts_big())


@query("D2_split_overlap", """
WITH m AS (SELECT user_id, bool_or(is_train) AS tr, bool_or(NOT is_train) AS te, bool_or(category = 'error') AS li FROM alerts GROUP BY 1)
SELECT 'train' AS "left", 'test' AS "right", count(*) FILTER (WHERE tr AND te) AS shared FROM m
UNION ALL SELECT 'train', 'live', count(*) FILTER (WHERE tr AND li) FROM m UNION ALL SELECT 'test', 'live', count(*) FILTER (WHERE te AND li) FROM m""")
def d2(v):
    a = v.alerts_leaky()
    return SP.split_overlap({
        "train": a.filter("is_train"), "test": a.filter("not is_train"), "live": a.filter("category = 'error'")})


@query("D3_incident_split", f"""
SELECT alert_id, CASE WHEN {HASH.format("incident_id")} < 0.8e0 THEN 'train' ELSE 'validation' END AS split FROM alerts""")
def d3(v):
    return SP.incident_split(v.alerts()).select("alert_id", "split")


@query("D3_incident_split_exact", f"""
SELECT incident_id, CASE WHEN row_number() OVER (ORDER BY {HASH.format("incident_id")}) <= floor(0.8e0 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT DISTINCT incident_id FROM alerts)""")
def d3e(v):
    return SP.incident_split_exact(v.alerts())


IDS = "SELECT DISTINCT incident_id FROM alerts WHERE grade = 'TruePositive' AND suspicion = 'High'"


SEVERE = "grade = 'TruePositive' and suspicion = 'High'"


@query("D4_partition_rows_in", f"SELECT alert_id FROM alerts WHERE incident_id IN ({IDS})")
def d4(v):
    a = v.alerts()
    return SP.partition_rows(a, SP.distinct_ids(a.filter(SEVERE)))[0].select("alert_id")


@query("D4_partition_rows_out", f"SELECT alert_id FROM alerts WHERE incident_id NOT IN ({IDS})")
def d4o(v):
    a = v.alerts()
    return SP.partition_rows(a, SP.distinct_ids(a.filter(SEVERE)))[1].select("alert_id")


@query("D5_attach_lineage", """
WITH p AS (SELECT concat('A', event_id - event_id % 2) AS alert_id, event_id, value FROM alerts0 WHERE k % 5 <> 0),
m AS (SELECT concat('A', event_id) AS alert_id, event_type FROM alerts0 WHERE k % 3 = 0)
SELECT a.alert_id, x.value AS processed_value, m.event_type AS mapped_type FROM alerts a
LEFT JOIN (SELECT alert_id, arg_max(value, event_id) AS value FROM p GROUP BY 1) x USING (alert_id) LEFT JOIN m USING (alert_id)""")
def d5(v):
    a = v.alerts()
    processed = a.filter("k % 5 <> 0").select(
        F.concat(F.lit("A"), (F.col("event_id") - F.col("event_id") % 2).cast("string")).alias("alert_id"),
        F.col("event_id").alias("ordinal"), "value")
    mapping = a.filter("k % 3 = 0").select("alert_id", F.col("event_id").alias("ordinal"), "category")
    out = J.attach_lineage(a.select("alert_id"), processed, mapping)
    return out.select("alert_id", F.col("processed.value").alias("processed_value"), F.col("lineage.category").alias("mapped_type"))


@query("D6_enrich_decisions", """
SELECT e.alert_id, e.seq::BIGINT AS seq, a.incident_id, a.category, coalesce(e.decided, a.status) AS status, a.verdict, a.assigned_analyst
FROM (SELECT * FROM activity WHERE action = 'AGENT_INFERENCE') e LEFT JOIN live_alerts a USING (alert_id)""")
def d6(v):
    e = v.activity().filter("action = 'AGENT_INFERENCE'").withColumn("status", F.col("decided"))
    out = J.enrich_decisions(e, v.live_alerts(), ["incident_id", "category", "status", "verdict", "assigned_analyst"])
    return out.select("alert_id", "seq", "incident_id", "category", "status", "verdict", "assigned_analyst")


@query("D7_route_by_prefix", "SELECT event_id, component FROM routed_requests")
def d7(v):
    return J.route_by_prefix(v.requests(), REQUEST_COMPONENTS).select("event_id", "component")


@query("D9_split_report", f"""
WITH s AS (SELECT user_id::VARCHAR AS incident_id, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split FROM alerts)
SELECT split, count(*) AS rows, count(*) / (SELECT count(*) FROM s) AS share, count(DISTINCT incident_id) AS incidents,
  (SELECT count(*) FROM (SELECT incident_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_incidents FROM s GROUP BY 1""")
def d9(v):
    a = v.alerts_leaky().withColumn("split", F.when(F.col("is_train"), "train").otherwise("test"))
    return SP.split_report(a)


@query("D11_union_runs", """
WITH r AS (SELECT user_id AS run_id, concat('/runs/', user_id % 100) AS path, count(*) AS points FROM alerts0 GROUP BY 1, 2)
SELECT run_id, path, points FROM r WHERE run_id % 4 < 2
UNION ALL SELECT run_id, path, points FROM r WHERE run_id % 4 >= 2 AND path NOT IN (SELECT path FROM r WHERE run_id % 4 < 2)""")
def d11(v):
    runs = v.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("points"))
    runs = runs.withColumn("path", F.concat(F.lit("/runs/"), (F.col("run_id") % 100).cast("string")))
    return J.union_runs(
        runs.filter("run_id % 4 = 0"), runs.filter("run_id % 4 = 1"), runs.filter("run_id % 4 >= 2")).select("run_id", "path", "points")


@query("D12_overlay_epoch_actions", """
WITH d AS (SELECT ts::DATE AS epoch_day, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(epoch_day, '%Y-%m-%d') AS epoch, CASE WHEN day(epoch_day) % 3 = 0 THEN -1 WHEN day(epoch_day) % 3 = 1 THEN clicks ELSE n END AS shown FROM d""")
def d12(v):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("epoch")
    n = v.table("events").groupBy(day).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("n"))
    third = F.substring("epoch", 9, 2).cast("int") % 3
    empty = F.create_map().cast("map<string,bigint>")
    history = n.select("epoch", F.create_map(F.lit("x"), F.lit(-1).cast("long")).alias("action_distribution"))
    raw = n.select(
        "epoch",
        F.when(third == 1, F.create_map(F.lit("x"), F.col("clicks"))).otherwise(empty).alias("sample_action_distribution"),
        F.when(third == 2, F.create_map(F.lit("x"), F.col("n"))).alias("other_distribution"))
    out = J.overlay_epoch_actions(history, raw, ["epoch"], ["sample_action_distribution", "other_distribution"])
    return out.select("epoch", F.element_at("action_distribution", F.lit("x")).alias("shown"))


@query("D13_refresh_source", """
SELECT alert_id, CASE WHEN k % 4 = 0 THEN concat(category, '!') ELSE category END AS source, k % 4 = 0 AS changed FROM alerts""")
def d13(v):
    a = v.alerts()
    fresh = a.filter("k % 2 = 0").select(
        "alert_id", F.when(F.col("k") % 4 == 0, F.concat("category", F.lit("!"))).otherwise(F.col("category")).alias("source"))
    fresh = fresh.unionByName(a.filter("k = 1").select(F.concat(F.lit("new-"), "alert_id").alias("alert_id"), F.lit("x").alias("source")))
    return J.refresh_source(a.select("alert_id", F.col("category").alias("source")), fresh).select("alert_id", "source", "changed")


@query("C4_recover_codebook", """
SELECT category AS value, min(c) AS code, count(DISTINCT c) AS codes FROM (
  SELECT category, CASE WHEN k = 7 AND category = 'view' THEN 99 ELSE dense_rank() OVER (ORDER BY category) - 1 END AS c FROM alerts) GROUP BY 1""")
def c4(v):
    a = v.alerts()
    book = N.fit_codebook(a, ["category"])
    coded = N.apply_codebook(a, book, ["category"]).select(
        "alert_id", F.when((F.col("k") == 7) & (F.col("category") == "view"), 99).otherwise(F.col("category_code")).alias("category_code"))
    return N.recover_codebook(a, coded, "alert_id", "category")


@query("C5_check_alignment", """
SELECT count(*) AS left_rows, count(*) FILTER (WHERE k <> 3) AS right_rows, count(*) FILTER (WHERE k = 3) AS unmatched, count(*) FILTER (WHERE k = 4) AS time_differs FROM alerts""")
def c5(v):
    a = v.alerts()
    other = a.filter("k <> 3").withColumn("ts", F.when(F.col("k") == 4, F.col("ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts")))
    return J.check_alignment(a, other, "alert_id", "ts")
