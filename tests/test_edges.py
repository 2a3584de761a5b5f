"""Missing numbers, repeated and missing keys, assignments, and answers that do not depend on partitions."""

import pytest
from pyspark.sql import functions as F

from triagemill.operators import encode as N
from triagemill.operators import events as E
from triagemill.operators import joins as J
from triagemill.operators import ordered as O
from triagemill.operators import policy as P
from triagemill.operators import quality as Q
from triagemill.operators import queues as QU
from triagemill.operators import runstats as RS
from triagemill.operators import sequences as S
from triagemill.operators import soc
from triagemill.sources import alerts as A

NAN = float("nan")


@pytest.fixture(scope="module")
def history(spark):
    rows = [("a", 1, 0.2), ("a", 2, NAN), ("a", 3, 0.6), ("a", 4, float("inf")), ("b", 1, NAN), ("b", 2, None), ("b", 3, 0.1)]
    return spark.createDataFrame(rows, "run_id string, epoch long, score double").withColumn("updates", F.col("epoch") * 10)


def test_nan_is_missing(spark, history):
    with pytest.raises(ValueError, match="score"):
        A.load_contract(history.filter("score is not null"), ["score"], ["score"])
    assert Q.audit_split(history).first()["missing"] == 3
    assert Q.missing_stats(history).first()["missing"] == 3
    row = Q.feature_health(history).filter("column = 'score'").first()
    assert (row["missing"], row["max"]) == (3, 0.6) and row["mean"] == pytest.approx(0.3)


def test_ranges_are_finite(history):
    ranges = N.fit_minmax(history, ["score"])
    assert tuple(ranges.first()["score"]) == (0.1, 0.6)
    scaled = [r["score_scaled"] for r in N.apply_minmax(history, ranges, ["score"]).collect()]
    assert sorted(x for x in scaled if x is not None) == pytest.approx([0.0, 0.2, 1.0]) and scaled.count(None) == 4


def test_nan_is_no_best_value(history):
    steps = {r["run_id"]: (r["epoch"], r["status"]) for r in RS.steps_to_threshold(history, 0.5, "score", "updates").collect()}
    assert steps == {"a": (3, "available"), "b": (None, "N/A")}
    best = {r["run_id"]: (r["best_epoch"], r["best_score"]) for r in RS.best_points(history, "score", "score").collect()}
    assert best == {"a": (3, 0.6), "b": (3, 0.1)}
    assert {r["run_id"]: r["iqm"] for r in RS.iqm(history, ["run_id"], "score").collect()} == pytest.approx({"a": 0.4, "b": 0.1})
    finals = {r["run_id"]: (r["points"], r["final_return"]) for r in RS.final_return_stats(history, "score").collect()}
    assert finals == {"a": (2, 0.6), "b": (1, 0.1)}
    profile = RS.performance_profile(history.withColumn("seed", F.col("epoch")), "score", [0.15]).first()
    assert profile["share"] == pytest.approx(2 / 3)


def test_bootstrap_is_reproducible(spark):
    rows = [("x", float(i * 37 % 101)) for i in range(2500)] + [(None, float(i)) for i in range(8)] + [("y", 1.0), ("y", NAN), ("z", 1.0), ("z", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen = [sorted((tuple(r) for r in RS.bootstrap_ci(df.repartition(n), "g", "v", reps=300).collect()), key=str) for n in (1, 3, 7)]
    strip = lambda t: [(g, n, lo and round(lo, 9), hi and round(hi, 9), s, why) for g, n, lo, hi, s, why in t]
    assert strip(seen[0]) == strip(seen[1]) == strip(seen[2])
    got = {r[0]: r for r in seen[0]}
    mean = sum(v for g, v in rows if g == "x") / 2500
    assert got["x"][2] < mean < got["x"][3] and got["x"][3] - got["x"][2] < 4
    assert 0 <= got[None][2] < 3.5 < got[None][3] <= 7 and got[None][4] == "available"
    assert got["y"][1:5] == (1, None, None, "N/A") and got["z"][2:4] == (1.0, 3.0)


def test_repeated_keys_of_a_batch(spark):
    alerts = spark.createDataFrame([("A", "old"), ("B", "old")], "alert_id string, source string")
    batch = spark.createDataFrame([("A", "x", 2), ("A", "y", 3), ("A", "w", 1)], "alert_id string, source string, n long")
    got = {r["alert_id"]: r["source"] for r in J.refresh_source(alerts, batch, ordinal="n").collect()}
    assert got == {"A": "y", "B": "old"} and J.refresh_source(alerts, batch).count() == 2
    table = E.upsert_dimension(alerts, batch.select("alert_id", "source", "n"), "alert_id", "n")
    assert sorted((r["alert_id"], r["source"]) for r in table.collect()) == [("A", "y"), ("B", "old")]


def test_missing_keys_are_kept(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("k", 1, 4.0)]
    df = spark.createDataFrame(rows, "incident_id string, event_id long, reward double").withColumn("ts", F.col("event_id"))
    got = sorted(((r["incident_id"], r["event_id"], r["return"]) for r in S.discounted_return(df, 0.5).collect()), key=str)
    assert got == sorted([(None, 1, 2.0), (None, 2, 2.0), ("k", 1, 4.0)], key=str)
    history = spark.createDataFrame([(None, i, s) for i, s in enumerate((0.1, 0.5, 0.4, 0.3), 1)], "run_id string, epoch long, score double")
    assert [tuple(r) for r in RS.replay_early_stopping(history, 0.01, 2, 1).collect()] == [(None, 2, 0.5, 4, "validation_patience_exhausted")]


def test_fingerprints_differ(spark):
    def of(rows, schema="a string, b string"):
        return P.fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"]

    tables = [([("x|y", "z")],), ([("x", "y|z")],), ([("~", "z")],), ([(None, "z")],), ([("x|y", "z")], "a string, c string"), ([("", "1:z")],), ([("1:z", "")],)]
    assert len({of(*t) for t in tables}) == len(tables)
    assert of([("p", "q"), ("r", "s")]) == of([("r", "s"), ("p", "q")])


def test_assignments_reach_the_state(spark):
    rows = [("A", 1, 0, "ALERT_IMPORTED", "system", None, None), ("A", 2, 1, "AGENT_INFERENCE", "agent", "human_review", None),
            ("A", 2, 2, "HUMAN_REVIEW_ROUTED", "system", None, ("an-1",)), ("A", 3, 3, "ASSIGNED", "SA", None, ("an-2",)),
            ("B", 1, 0, "HUMAN_REVIEW_ROUTED", "system", None, ("an-1",)), ("B", 2, 1, "HUMAN_APPROVED", "an-3", None, ("x",))]
    log = spark.createDataFrame(rows, "alert_id string, ts long, seq long, action string, actor string, decided string, details struct<analyst_id:string>")
    got = {r["alert_id"]: (r["status"], r["assigned_analyst"], r["last_human_decision"]) for r in E.current_alert_state(log).collect()}
    assert got == {"A": ("HUMAN_REVIEW_PENDING", "an-2", None), "B": ("APPROVED", "an-3", "APPROVED")}


def test_many_blocks(spark):
    """As many blocks as a large cluster has partitions."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    hot = O.hot_keys(df, ["k"], 20_000)
    assert df.select(F.xxhash64(F.lit(1).cast("long"))).first()[0] in hot


def test_truth_in_order(spark):
    events = spark.createDataFrame([("A", "block"), ("B", None), ("C", "allow")], "alert_id string, decided string")
    make = lambda rows, extra="": spark.createDataFrame(rows, "alert_id string, IncidentGrade string" + extra)
    alerts = make([("A", "FalsePositive", "x"), ("B", "TruePositive", "block"), ("C", "TruePositive", "y")], ", action string")
    source, lineage = make([("A", "TruePositive")]), make([("A", "BenignPositive"), ("C", "FalsePositive")])
    got = {r["alert_id"]: (r["decided"], r["truth"], r["positive"]) for r in soc.with_truth(events, alerts, source, lineage, "action").collect()}
    assert got == {"A": ("block", "TruePositive", True), "B": ("block", "TruePositive", True), "C": ("allow", "FalsePositive", False)}


def test_pages_by_last_row(spark):
    rows = [(f"A{i}", i, None if i % 7 == 0 else i // 3) for i in range(40)]
    alerts = spark.createDataFrame(rows, "alert_id string, event_id long, ts long")
    want = [r["event_id"] for r in QU.newest_first(alerts).collect()]
    got, last = [], None
    while page := QU.page_after(alerts, last, limit=9).collect():
        got += [r["event_id"] for r in page]
        last = (page[-1]["ts"], page[-1]["event_id"])
    assert got == want
    assert QU.page_alerts(alerts, skip=100).count() == 0 and QU.matching_total(alerts).first()["total"] == 40
