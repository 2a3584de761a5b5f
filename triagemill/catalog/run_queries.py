"""Ordered alerts (F) and run statistics (G13, G19-G25)."""

from pyspark.sql import functions as F

from triagemill.catalog.base import query
from triagemill.catalog.policy_queries import scored
from triagemill.catalog.soc_queries import rounded
from triagemill.operators import runstats as RS
from triagemill.operators import sequences as S
from triagemill.operators.evaluate import greedy_action, score_rewards

STEP = "row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) - 1"


@query("F1_order_incidents", f"""
SELECT alert_id, {STEP} AS "position", count(*) OVER (PARTITION BY incident_id) AS group_size FROM alerts""")
def f1(v):
    return S.order_incidents(v.alerts().select("alert_id", "event_id", "incident_id", "ts")).select("alert_id", "position", "group_size")


def stated(v, key="incident_id"):
    return v.alerts().select("alert_id", "event_id", F.col(key).cast("string").alias("incident_id"), "ts", "grade_code", "k",
                             F.struct("q0", "q1").alias("state"))


@query("F2_transitions", f"""
SELECT alert_id, {STEP} AS step, q0, coalesce(lead(q0) OVER w, q0) AS next_q0, coalesce(lead(q1) OVER w, q1) AS next_q1, lead(q0) OVER w IS NULL AS done
FROM alerts WINDOW w AS (PARTITION BY incident_id ORDER BY ts, event_id)""")
def f2(v):
    return S.transitions(stated(v)).select(
        "alert_id", "step", F.col("state.q0").alias("q0"), F.col("next_state.q0").alias("next_q0"),
        F.col("next_state.q1").alias("next_q1"), "done")


@query("F2_transitions_by_user", """
SELECT alert_id, row_number() OVER w - 1 AS step, coalesce(lead(q0) OVER w, q0) AS next_q0, lead(q0) OVER w IS NULL AS done
FROM alerts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def f2u(v):
    return S.transitions(stated(v, "user_id")).select("alert_id", "step", F.col("next_state.q0").alias("next_q0"), "done")


@query("F3_action_expanded_transitions", f"""
SELECT alert_id, {STEP} AS step, action::BIGINT AS action, [r0, r1, r2][action + 1] AS reward
FROM (SELECT *, unnest([0, 1, 2]) AS action FROM (SELECT * REPLACE (grade_code AS grade_code) FROM rewarded)) QUALIFY true""".replace(
    f"{STEP} AS step", "row_number() OVER (PARTITION BY incident_id, action ORDER BY ts, event_id) - 1 AS step").replace(" QUALIFY true", ""))
def f3(v):
    return S.action_expanded_transitions(S.transitions(stated(v))).select("alert_id", "step", "action", "reward")


@query("F4_logged_transitions", f"""
SELECT alert_id, step, k % 5 AS action, [r0, r1, r2][k % 5 + 1] AS reward FROM (SELECT *, {STEP} AS step FROM rewarded) WHERE k % 5 < 3""")
def f4(v):
    logged = F.when(F.col("k") % 5 == 4, "none").otherwise((F.col("k") % 5).cast("string"))
    steps = S.transitions(stated(v).withColumn("logged_action", logged))
    return S.logged_transitions(steps).select("alert_id", "step", "action", "reward")


# returns are short decimals that often end in a 5 at the rounded digit; both sides step off it
def nudged():
    return (F.col("return") + 1e-9).alias("return")


@query("F5_discounted_return", """
SELECT alert_id, round(sum(reward * pow(0.95e0, step)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.95e0, step) + 1e-9, 6) AS return
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM scored)""")
def f5(v):
    rows = scored(v).select("alert_id", "user_id", "event_id", "ts", "reward")
    return rounded(S.discounted_return(rows, 0.95, keys=["user_id"]).select("alert_id", nudged()))


@query("F5_discounted_return_pieces", """
SELECT alert_id, round(sum(reward * pow(0.95e0, step)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.95e0, step) + 1e-9, 6) AS return
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM scored)""")
def f5p(v):
    rows = scored(v).select("alert_id", "user_id", "event_id", "ts", "reward")
    return rounded(S.discounted_return(rows, 0.95, keys=["user_id"], longest=16).select("alert_id", nudged()))


@query("F6_normalised_advantage", """
SELECT alert_id, round(CASE WHEN n > 1 AND s > 1e-8 THEN (a - m) / (s + 1e-8) ELSE a END, 6) AS advantage FROM (
  SELECT alert_id, value - q0 AS a, avg(value - q0) OVER w AS m, stddev_pop(value - q0) OVER w AS s, count(*) OVER w AS n FROM alerts WINDOW w AS (PARTITION BY incident_id))""")
def f6(v):
    a = v.alerts().select("alert_id", "incident_id", "value", "q0")
    return rounded(S.normalised_advantage(a, "incident_id", "value", "q0").select("alert_id", "advantage"))


@query("F7_last_n", "SELECT run_id, epoch, score FROM run_history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 10")
def f7(v):
    return RS.last_n(v.run_history().select("run_id", "epoch", "score"), 10)


@query("F7_last_n_range", """
SELECT run_id, count(*) AS points, min(score) AS lowest, max(score) AS highest FROM (
  SELECT * FROM run_history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 10) GROUP BY 1""")
def f7r(v):
    return RS.last_n_range(v.run_history().select("run_id", "epoch", "score"), 10, "score")


FOLD = """WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM run_history), f AS (
  SELECT run_id, 1::BIGINT AS epoch, score AS best, 1::BIGINT AS best_epoch, 0 AS waited, false AS stop FROM h WHERE epoch = 1
  UNION ALL
  SELECT h.run_id, h.epoch, CASE WHEN h.score > f.best + 0.01e0 THEN h.score ELSE f.best END, CASE WHEN h.score > f.best + 0.01e0 THEN h.epoch ELSE f.best_epoch END,
    CASE WHEN h.score > f.best + 0.01e0 THEN 0 ELSE f.waited + 1 END, h.epoch >= 5 AND h.score <= f.best + 0.01e0 AND f.waited + 1 >= {patience}
  FROM f JOIN h ON h.run_id = f.run_id AND h.epoch = f.epoch + 1 WHERE NOT f.stop)"""


# of every epoch: the fold without an end, and the two exits that look back on six validations
LOOK_BACK = FOLD.format(patience=1000000) + """,
w AS (SELECT f.run_id, f.epoch, f.best, f.best_epoch, f.waited, h.score, count(*) OVER s AS n, max(h.score) OVER s AS hi, min(h.score) OVER s AS lo,
  max(h.loss) OVER s AS rhi, min(h.loss) OVER s AS rlo,
  avg(h.loss) OVER s AS ravg, sum((h.score <= p.score + 0.0025e0)::INT) OVER (PARTITION BY f.run_id ORDER BY f.epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS falls
  FROM f JOIN h USING (run_id, epoch) LEFT JOIN h p ON p.run_id = f.run_id AND p.epoch = f.epoch - 1
  WINDOW s AS (PARTITION BY f.run_id ORDER BY f.epoch ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
g AS (SELECT run_id, epoch, best, best_epoch, waited, n = 6 AND epoch >= {min_epochs} AND hi - lo <= 0.02e0
    AND rhi - rlo <= greatest(0.02e0, greatest(abs(ravg), 1e0) * 0.0025e0) AND hi <= best + 0.01e0 AS converged,
  n = 6 AND epoch >= {min_epochs} AND score < best - 0.01e0 AND falls = 5 AS declining FROM w)"""


@query("F8_replay_early_stopping", LOOK_BACK.replace("{min_epochs}", "5") + """,
x AS (SELECT *, CASE WHEN declining THEN 'persistent_validation_decline' WHEN converged THEN 'validation_and_policy_converged'
  WHEN epoch >= 5 AND waited >= 8 THEN 'validation_patience_exhausted' END AS why FROM g),
y AS (SELECT *, coalesce(min(epoch) FILTER (WHERE why IS NOT NULL) OVER r, max(epoch) OVER r) AS ends FROM x WINDOW r AS (PARTITION BY run_id))
SELECT run_id, best_epoch, best AS best_score, epoch AS validations_used, coalesce(why, 'max_epochs_reached') AS stopping_reason FROM y WHERE epoch = ends""")
def f8(v):
    return RS.replay_early_stopping(
        v.run_history().select("run_id", "epoch", "score", "loss"), 0.01, 8, 5, tolerance=0.02, reward="loss")


@query("F8_replay_patience_only", FOLD.format(patience=8) + """
SELECT run_id, best_epoch, best AS best_score, epoch AS validations_used, CASE WHEN stop THEN 'validation_patience_exhausted' ELSE 'max_epochs_reached' END AS stopping_reason
FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1""")
def f8p(v):
    return RS.replay_early_stopping(v.run_history().select("run_id", "epoch", "score"), 0.01, 8, 5)


@query("F8_stability_flags", LOOK_BACK.replace("{min_epochs}", "10") + """
SELECT run_id, epoch, best AS best_so_far, converged, declining FROM g""")
def f8s(v):
    return RS.stability_flags(
        v.run_history().select("run_id", "epoch", "score", "loss"), 0.01, 0.02, 10, reward="loss", piece=7)


@query("F9_steps_to_threshold", """
SELECT run_id, min(epoch) FILTER (WHERE score >= 0.15e0) AS epoch, arg_min(updates, epoch) FILTER (WHERE score >= 0.15e0) AS updates,
  CASE WHEN max(score) >= 0.15e0 THEN 'available' ELSE 'N/A' END AS status FROM run_history GROUP BY 1""")
def f9(v):
    return RS.steps_to_threshold(v.run_history(), 0.15, "score", "updates")


@query("F10_latest_by_time", """
SELECT alert_id, action, actor FROM activity QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, seq DESC) = 1""")
def f10(v):
    return RS.latest_by_time(v.activity(), "alert_id", ["action", "actor"], "ts", "seq")


@query("F11_first_event", """
SELECT alert_id, arg_min(action, (ts, seq)) AS first_human, epoch_us(min(ts)) AS at FROM activity WHERE starts_with(action, 'HUMAN_') GROUP BY 1""")
def f11(v):
    from triagemill.operators.events import first_event
    return first_event(v.activity(), prefix="HUMAN_").select("alert_id", F.col("action").alias("first_human"), F.unix_micros("ts").alias("at"))


@query("F12_best_points", """
SELECT run_id, arg_min(epoch, (-score, epoch)) AS best_epoch, max(score) AS best_score, max(value) AS best_reward FROM run_history GROUP BY 1""")
def f12(v):
    return RS.best_points(v.run_history(), "score", "value")


@query("F13_cumulative_updates", """
SELECT run_id, epoch, updates, (sum(updates) OVER (PARTITION BY run_id ORDER BY epoch))::BIGINT AS total_updates FROM run_history""")
def f13(v):
    return RS.cumulative_updates(v.run_history().select("run_id", "epoch", "updates")).select("run_id", "epoch", "updates", "total_updates")


@query("G13_action_share", """
SELECT seed, action, round(count(*) / sum(count(*)) OVER (PARTITION BY seed)::DOUBLE, 6) AS share FROM run_history GROUP BY 1, 2""")
def g13(v):
    return rounded(RS.action_share(v.run_history(), ["seed"], "action", ["click", "view", "error", "purchase", "signup"]))


@query("G15_prediction_rows", f"""
SELECT alert_id, step, grade_code AS label, first_action::BIGINT AS action, reward, best, q0 AS q_allow, q1 AS q_block, q2 AS q_human_review, step = n - 1 AS done
FROM (SELECT *, {STEP} AS step, count(*) OVER (PARTITION BY incident_id) AS n FROM scored)""")
def g15(v):
    steps = S.order_incidents(score_rewards(greedy_action(v.alerts())))
    return steps.select(
        "alert_id", F.col("position").alias("step"), F.col("grade_code").alias("label"), "action", "reward", "best",
        F.col("q0").alias("q_allow"), F.col("q1").alias("q_block"), F.col("q2").alias("q_human_review"),
        (F.col("position") == F.col("group_size") - 1).alias("done"))


IQM = """WITH r AS (SELECT {key} AS g, score, row_number() OVER (PARTITION BY {key} ORDER BY score) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM run_history)
SELECT {out}round(avg(score) FILTER (WHERE rn >= CASE WHEN n >= 4 THEN n // 4 ELSE 0 END AND rn < n - CASE WHEN n >= 4 THEN n // 4 ELSE 0 END) + 1e-9, 6) AS iqm, max(n) AS n FROM r GROUP BY g"""


@query("G19_iqm", IQM.format(key="run_id", out="g AS run_id, "))
def g19(v):
    return rounded(RS.iqm(v.run_history(), ["run_id"], "score").withColumn("iqm", F.col("iqm") + 1e-9))


@query("G19_iqm_overall", IQM.format(key="1", out=""))
def g19o(v):
    return rounded(RS.iqm(v.run_history(), [], "score").withColumn("iqm", F.col("iqm") + 1e-9))


FINALS = "finals AS (SELECT run_id, seed, arg_max(score, epoch) AS final_return FROM run_history GROUP BY 1, 2)"


def _poisson_sql(u: str) -> str:
    edge, term, parts = 0.0, 2.718281828459045**-1, []
    for i in range(13):
        edge += term
        parts.append(f"CAST({u} >= {min(int(edge * 2**31), 2**31 - 1)} AS INT)")
        term /= i + 1
    return " + ".join(parts)


@query("G20_bootstrap_ci", f"""
WITH {FINALS}, a AS (SELECT seed, final_return AS v, row_number() OVER (PARTITION BY seed ORDER BY final_return) - 1 AS pos,
    ('0x' || substr(md5(concat_ws(':', '20260818', seed)), 1, 7))::BIGINT AS g FROM finals),
h0 AS (SELECT seed, v, (g + (pos & 2147483647) * 1103515245) & 2147483647 AS x FROM a),
h1 AS (SELECT seed, v, (xor(x, x >> 16) * 73244475) & 2147483647 AS x FROM h0),
h2 AS (SELECT seed, v, (xor(x, x >> 16) * 73244475) & 2147483647 AS x FROM h1),
h3 AS (SELECT seed, v, xor(x, x >> 16) AS x FROM h2),
u0 AS (SELECT seed, v, rep, (x + rep * 1664525) & 2147483647 AS x FROM h3, (SELECT unnest(range(0, 10000)) AS rep)),
u1 AS (SELECT seed, v, rep, (xor(x, x >> 16) * 73244475) & 2147483647 AS x FROM u0),
u2 AS (SELECT seed, v, rep, (xor(x, x >> 16) * 73244475) & 2147483647 AS x FROM u1),
u3 AS (SELECT seed, v, rep, xor(x, x >> 16) AS x FROM u2),
w AS (SELECT seed, v, rep, {_poisson_sql("x")} AS w FROM u3),
m AS (SELECT seed, rep, sum(v * w) / sum(w) AS mean FROM w GROUP BY 1, 2 HAVING sum(w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mean) - 1 AS rk, count(*) OVER (PARTITION BY seed) AS c FROM m),
b AS (SELECT seed, max(mean) FILTER (WHERE rk = floor(0.025e0 * (c - 1))) AS lower, max(mean) FILTER (WHERE rk = floor(0.975e0 * (c - 1))) AS upper FROM r GROUP BY 1),
n AS (SELECT seed, count(*) AS n FROM a GROUP BY 1)
SELECT seed, n, CASE WHEN n > 1 THEN round(lower, 6) END AS lower, CASE WHEN n > 1 THEN round(upper, 6) END AS upper,
  CASE WHEN n > 1 THEN 'available' ELSE 'N/A' END AS status, CASE WHEN n < 2 THEN 'needs two or more results' END AS reason FROM n JOIN b USING (seed)""")
def g20(v):
    finals = v.run_history().groupBy("run_id", "seed").agg(F.max_by("score", "epoch").alias("final_return"))
    return rounded(RS.bootstrap_ci(finals, "seed", "final_return"))


LAST10 = "last10 AS (SELECT * FROM run_history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 10)"


@query("G21_final_return_stats", f"""
WITH {LAST10}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score) - 1 AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM last10)
SELECT run_id, count(*) AS points, round(avg(score), 6) AS mean_last,
  round(avg(score) FILTER (WHERE rn >= CASE WHEN n >= 4 THEN n // 4 ELSE 0 END AND rn < n - CASE WHEN n >= 4 THEN n // 4 ELSE 0 END), 6) AS iqm_last,
  arg_max(score, epoch) AS final_return FROM r GROUP BY 1""")
def g21(v):
    return RS.final_return_stats(v.run_history(), "score").withColumns(
        {"mean_last": F.round("mean_last", 6), "iqm_last": F.round("iqm_last", 6)})


@query("G22_per_seed_results", f"""
WITH {LAST10} SELECT run_id, any_value(seed) AS seed, arg_max(score, epoch) AS final_return, round(avg(score), 6) AS mean_last_10 FROM last10 GROUP BY 1""")
def g22(v):
    h = v.run_history()
    runs = h.groupBy("run_id").agg(F.max("seed").alias("seed"))
    return RS.per_seed_results(runs, h, "score").withColumn("mean_last_10", F.round("mean_last_10", 6))


@query("G23_performance_profile", f"""
WITH {FINALS} SELECT t AS threshold, round(avg(CASE WHEN final_return >= t THEN 1e0 ELSE 0e0 END), 6) AS share, (SELECT count(DISTINCT seed) FROM finals) AS seeds, 'available' AS status
FROM finals, (SELECT unnest([0.01e0, 0.03e0, 0.1e0]) AS t) GROUP BY t""")
def g23(v):
    finals = v.run_history().groupBy("run_id", "seed").agg(F.max_by("score", "epoch").alias("final_return"))
    return rounded(RS.performance_profile(finals, "final_return", [0.01, 0.03, 0.1]))


@query("G24_run_catalog", """
WITH r AS (SELECT user_id AS run_id, count(*) AS metric_count, max(ts) AS last_ts, min(ts) AS first_ts FROM alerts0 GROUP BY 1)
SELECT run_id, metric_count, CASE run_id % 3 WHEN 0 THEN CAST(floor(epoch(last_ts)) AS BIGINT) * 1000000 WHEN 1 THEN epoch_us(first_ts) ELSE 0 END AS sort_micros FROM r""")
def g24(v):
    runs = v.table("events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("metric_count"), F.max(F.col("ts").cast("timestamp")).alias("l"), F.min(F.col("ts").cast("timestamp")).alias("f"))
    runs = runs.withColumns({
        "completed_at": F.when(F.col("run_id") % 3 == 0, F.unix_seconds("l").cast("string")).otherwise("soon"),
        "started_at": F.when(F.col("run_id") % 3 == 1, F.date_format("f", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))})
    return RS.run_catalog(runs, ["completed_at", "finished_at", "started_at"]).select("run_id", "metric_count", "sort_micros")


@query("G25_dashboard_summary", """
WITH h AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM train GROUP BY 1),
t AS (SELECT count(*) AS n, avg(reward) AS r, avg(processing_s * 1000) AS l FROM scored WHERE NOT is_train)
SELECT (SELECT sum(n) FROM h)::BIGINT + t.n AS total_alerts, t.n AS processed_alerts,
  (SELECT count(*) FROM activity WHERE action = 'AGENT_INFERENCE') AS total_decisions, (SELECT count(*) FROM feedback) AS total_rewards,
  round(r, 6) AS average_reward, round(l, 6) AS average_latency, 0e0 AS accuracy, 'healthy' AS database_status, 'completed' AS training_status,
  (SELECT count(*) FROM h) AS current_episode FROM t""")
def g25(v):
    per_day = v.train().groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # one row per day of the calendar: the running total is over days, not alerts
    from pyspark.sql import Window
    days = Window.partitionBy().orderBy("d")
    history = per_day.select(F.row_number().over(days).cast("long").alias("epoch"), F.sum("n").over(days).alias("rows_seen"))
    tests = scored(v).filter("not is_train").withColumn("latency_ms", F.col("processing_s") * 1000)
    return rounded(RS.dashboard_summary(history, tests, v.activity().filter("action = 'AGENT_INFERENCE'"), v.feedback()))
