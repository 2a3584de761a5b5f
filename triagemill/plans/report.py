"""The operational report: one row from the alert table and its event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.operators import soc
from triagemill.operators.ordered import exact_percentiles
from triagemill.session import settle


def operational_report(alerts: DataFrame, activity: DataFrame) -> DataFrame:
    """Latency, response time, confusion, rates and shares.

    The event log is read and aggregated once; the narrow per-alert result is
    settled and serves both the sums and the rank arithmetic.
    """
    judged = soc.with_truth(soc.timings(soc.pair_events(activity)), alerts)
    rows = settle(judged.select("latency", "response", "decided", "positive"), "timings")
    did = F.col("decided")
    sums = rows.agg(
        F.count(F.lit(1)).alias("alerts_with_timing"), F.avg("latency").alias("mean_latency_s"),
        F.max("latency").alias("max_latency_s"), F.avg("response").alias("mttr_s"),
        F.count_if(did == "human_review").alias("reviewed"), F.count_if(did.isin("allow", "block")).alias("automated"),
        *soc.confusion_counts())
    total = alerts.agg(F.count(F.lit(1))).scalar()
    ranks = exact_percentiles(rows, [], "latency", {"median": 0.5, "p95": 0.95}).select(F.struct("*")).scalar()
    out = soc.detection_rates(sums.withColumns({"alerts_total": total, "_p": ranks}))
    return out.select(
        "alerts_total", "alerts_with_timing", "mean_latency_s", F.col("_p.median").alias("median_latency_s"),
        F.col("_p.p95").alias("p95_latency_s"), "max_latency_s", "mttr_s", "tp", "fp", "fn", "tn",
        "abstain_true_positive", "abstain_negative", "precision", "recall", "f1_score", "false_positive_rate",
        "false_negative_rate", F.try_divide("reviewed", "alerts_total").alias("human_review_rate"),
        F.try_divide("automated", "alerts_total").alias("automation_rate"))
