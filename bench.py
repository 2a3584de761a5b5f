"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from triagemill import catalog
from triagemill.session import get_session

HEADLINE = [
    "G10_G11_evaluate_all", "G10_evaluate_policy", "G11_evaluate_by_class", "operational_report", "H1_decision_latency",
    "H3_operational_confusion", "E11_composite_reward", "C2_apply_codebook", "F2_transitions", "F5_discounted_return",
    "G4_feature_health", "G5_information_gain", "D2_split_overlap", "J3_gate_decision", "J1_score_actions",
    "J5_route_to_analysts", "J6_decide_batch", "P1_page_alerts", "K3_current_alert_state", "K2_decide_stateless",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/events.parquet").count()
    spent = {}
    for name in chosen:
        best = None
        for _ in range(2):  # the second run has warm code, as in a long-lived session
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        spent[name] = round(best, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    alerts = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {}
    if "G10_G11_evaluate_all" in spent:  # totals, classes and incidents of all lines, Parquet read included
        rates["evaluate_rows_per_s"] = round(lines / spent["G10_G11_evaluate_all"])
    if "J3_gate_decision" in spent:
        rates["gate_alerts_per_s"] = round(alerts / spent["J3_gate_decision"])
    if "J6_decide_batch" in spent:
        decided = queries["J6_decide_batch"](spark, folder).count()
        rates["decide_batch_alerts_per_s"] = round(decided / spent["J6_decide_batch"])
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "rows": {"lineitem": lines, "events": alerts}, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
