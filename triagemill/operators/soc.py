"""Operational metrics from the alert table and its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS, OPEN_STATUSES
from triagemill.functions.missing import present
from triagemill.functions.rewards import action_name, code_of
from triagemill.operators.ordered import exact_percentiles, value_summary

TRUTH_NAMES = ["IncidentGrade", "incident_grade", "ground_truth", "GroundTruth", "grade"]


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def pair_events(events: DataFrame) -> DataFrame:
    """Per alert: first import, first inference with its action, first human event.

    One map-side combined aggregate replaces a lookup per alert. Alerts without
    both an import and an inference are left out. All buffers are numbers (the
    action is packed under its time), so Spark can aggregate in a hash map
    without sorting.
    """
    action = F.col("action")
    human = action.startswith("HUMAN_")
    code = F.coalesce(code_of(F.col("decided"), ACTIONS), F.lit(len(ACTIONS)))
    packed = F.unix_micros("ts") * 4 + code
    per = events.groupBy("alert_id").agg(
        F.min(F.when(action == "ALERT_IMPORTED", F.col("ts"))).alias("received"),
        F.min(F.when(action == "AGENT_INFERENCE", packed)).alias("_first"),
        F.min(F.when(human, F.col("ts"))).alias("human_at"),
        F.min(F.when(human & (F.col("actor") != "system"), F.col("ts"))).alias("analyst_at"),
    )
    return per.filter(F.col("received").isNotNull() & F.col("_first").isNotNull()).select(
        "alert_id", "received", F.timestamp_micros(F.shiftright("_first", 2)).alias("decided_at"),
        action_name(F.pmod("_first", F.lit(4))).alias("decided"), "human_at", "analyst_at")


def timings(paired: DataFrame, human_only: bool = False) -> DataFrame:
    """Decision latency and response time per alert, never negative.

    By default the clock stops at the first ``HUMAN_`` event, which includes the
    routing by the system; ``human_only`` waits for a person.
    """
    end = F.coalesce(F.col("analyst_at" if human_only else "human_at"), F.col("decided_at"))
    zero = F.lit(0.0)
    return paired.withColumns({
        "latency": F.greatest(zero, seconds_between(F.col("received"), F.col("decided_at"))),
        "response": F.greatest(zero, seconds_between(F.col("received"), end))})


def decision_latency(timed: DataFrame) -> DataFrame:
    """Count, mean, median, p95, extremes of the latency in one row."""
    t = value_summary(timed, [], "latency", {"median": 0.5, "p95": 0.95})
    return t.select(
        "count", *[F.col(c).alias(f"{c}_seconds") for c in ("mean", "median", "p95", "max", "min")],
        F.when(F.col("count") > 0, "available").otherwise("N/A").alias("status"))


def mttr(timed: DataFrame) -> DataFrame:
    return timed.agg(F.avg("response").alias("mttr_seconds"), F.count("response").alias("alerts"))


def with_truth(
    paired: DataFrame, alerts: DataFrame, source: DataFrame | None = None, lineage: DataFrame | None = None,
    action: str | None = None,
) -> DataFrame:
    """Attach the verified grade and whether it is a true positive.

    The grade is looked up in the source record, then in the lineage, then in the alert (tables with one row per
    alert_id). With ``action``, a column of the alerts, a decision that the events lack is taken from there.
    """
    joined, found = paired, []
    for i, table in enumerate((source, lineage, alerts)):
        if table is None:
            continue
        names = [present(F.col(n)) for n in TRUTH_NAMES if n in table.columns]
        fields = [F.coalesce(*names).alias(f"_truth{i}")] if names else []
        found += [F.col(f"_truth{i}")] if names else []
        if table is alerts and action:
            fields.append(F.col(action).alias("_action"))
        joined = joined.join(table.select("alert_id", *fields), "alert_id", "left")
    if action:
        joined = joined.withColumn("decided", F.coalesce("decided", "_action")).drop("_action")
    joined = joined.withColumn("truth", F.coalesce(*found)).drop(*[f"_truth{i}" for i in range(3)])
    return joined.withColumn("positive", F.coalesce(F.col("truth") == "TruePositive", F.lit(False)))


def confusion_counts() -> list[Column]:
    did, pos = F.col("decided"), F.col("positive")
    return [
        F.count_if((did == "block") & pos).alias("tp"), F.count_if((did == "block") & ~pos).alias("fp"),
        F.count_if((did == "allow") & pos).alias("fn"), F.count_if((did == "allow") & ~pos).alias("tn"),
        F.count_if((did == "human_review") & pos).alias("abstain_true_positive"),
        F.count_if((did == "human_review") & ~pos).alias("abstain_negative"),
    ]


def operational_confusion(judged: DataFrame) -> DataFrame:
    return judged.agg(*confusion_counts())


def detection_rates(confusion: DataFrame) -> DataFrame:
    """Rates of a confusion row; null where the denominator is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confusion.select(
        "*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"), F.try_divide(fn, fn + tp).alias("false_negative_rate"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1_score", F.try_divide(2 * p * r, p + r))


def automation_rates(paired: DataFrame, alerts: DataFrame) -> DataFrame:
    """Shares of reviewed and of automated alerts among all alerts."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    did = F.col("decided")
    t = paired.agg(F.count_if(did == "human_review").alias("reviewed"), F.count_if(did.isin("allow", "block")).alias("automated"))
    return t.withColumn("alerts_total", total).select(
        "alerts_total", "reviewed", "automated",
        F.try_divide(F.col("reviewed"), F.col("alerts_total")).alias("human_review_rate"),
        F.try_divide(F.col("automated"), F.col("alerts_total")).alias("automation_rate"))


def throughput(alerts: DataFrame, timed: DataFrame, time: str = "ts") -> DataFrame:
    """Alerts per second over the observed span, with the two target flags."""
    t = alerts.agg(
        F.count(F.lit(1)).alias("alerts"), seconds_between(F.min(time), F.max(time)).alias("duration_seconds"))
    t = t.withColumn("per_second", F.when(F.col("duration_seconds") > 0, F.col("alerts") / F.col("duration_seconds")))
    p95 = exact_percentiles(timed, [], "latency", {"p95": 0.95}).select("p95").scalar()
    return t.withColumn("p95_seconds", p95).select(
        "alerts", "duration_seconds", "per_second", (F.col("per_second") * 86400).alias("per_day"),
        (F.col("per_second") >= 10000 / 86400).alias("meets_10k_per_day"),
        "p95_seconds", (F.col("p95_seconds") < 0.5).alias("meets_500ms"))


def audit_completeness(alerts: DataFrame, required: list[str]) -> DataFrame:
    filled = F.lit(True)
    for name in required:
        filled = filled & F.col(name).isNotNull() & (F.col(name).cast("string") != "")
    t = alerts.agg(F.count(F.lit(1)).alias("total"), F.count_if(filled).alias("complete"))
    return t.withColumn("rate", F.try_divide(F.col("complete"), F.col("total")))


def workload_join(analysts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Active analysts with the number of their open alerts, zero kept."""
    load = (
        alerts.filter(F.col("status").isin(OPEN_STATUSES) & F.col("assigned_analyst").isNotNull())
        .groupBy(F.col("assigned_analyst").alias("analyst_id")).agg(F.count(F.lit(1)).alias("load"))
    )
    return analysts.filter("active").join(load, "analyst_id", "left").na.fill(0, ["load"])


def analyst_workload(analysts: DataFrame, alerts: DataFrame) -> DataFrame:
    rows = workload_join(analysts, alerts)
    cap = F.coalesce(F.col("capacity"), F.lit(0))
    return rows.withColumns({
        "available": F.greatest(cap - F.col("load"), F.lit(0)),
        "utilization": F.when(cap > 0, F.col("load") / cap).otherwise(0.0),
        "utilization_or_null": F.when(cap > 0, F.col("load") / cap)})


def workload_summary(workload: DataFrame) -> DataFrame:
    return workload.agg(
        F.coalesce(F.avg("load"), F.lit(0.0)).alias("average_load"),
        F.coalesce(F.var_pop("load"), F.lit(0.0)).alias("load_variance"),
        F.max("utilization_or_null").alias("maximum_utilization"),
        F.min_by("analyst_id", F.struct(-F.col("load"), F.col("analyst_id"))).alias("most_loaded"),
        F.min_by("analyst_id", F.struct(F.col("load"), F.col("analyst_id"))).alias("least_loaded"))


def status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if("requires_human_review").alias("human_review_pending"),
        F.count_if(F.col("agent_status") == "INFERRED").alias("agent_decisions"))


def cycle_summary(decisions: DataFrame, errors: DataFrame) -> DataFrame:
    """Totals of one decision cycle; ``decisions`` has action and assigned_analyst."""
    failed = errors.agg(F.count(F.lit(1))).scalar()
    t = decisions.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("assigned_analyst").isNotNull()).alias("routed"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("allow", "block", "human_review")])
    return t.withColumn("errors", failed).withColumns({
        "considered": F.col("processed") + F.col("errors"),
        "status": F.when(F.col("errors") == 0, "completed").otherwise("completed_with_errors")})


def metric_or_na(metrics: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """One-row metrics as (name, value, status, reason); missing stays missing."""
    names = [c for c in metrics.columns]
    long = metrics.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "name", "value")
    for name in reasons:
        if name not in names:
            extra = metrics.limit(1).select(F.lit(name).alias("name"), F.lit(None).cast("double").alias("value"))
            long = long.unionByName(extra)
    pairs = [F.lit(x) for kv in reasons.items() for x in kv]
    why = F.element_at(F.create_map(*pairs), F.col("name")) if pairs else F.lit(None).cast("string")
    gone = F.col("value").isNull()
    return long.select(
        "name", "value", F.when(gone, "N/A").otherwise("available").alias("status"),
        F.when(gone, F.coalesce(why, F.lit("input missing"))).alias("reason"))
