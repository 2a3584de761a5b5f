"""Gates, routing, rewards and policies on hand-written rows."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triagemill.functions import rewards as R
from triagemill.functions import scoring as SC
from triagemill.operators import decide as D
from triagemill.operators import evaluate as E
from triagemill.operators import events as EV
from triagemill.operators import policy as P


def test_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.1],), ([0.1, 0.9, 0.9],), ([1.0, 1.0, 1.0],)], "q array<double>")
    got = [tuple(r) for r in df.select(SC.first_max(F.col("q")), SC.last_max(F.col("q"))).collect()]
    assert got == [(0, 1), (1, 2), (0, 2)]


def test_softmax_matches_numpy_and_clips(spark):
    qs = [[0.1, -2.0, 3.0], [1000.0, 0.0, -1000.0]]
    df = spark.createDataFrame([(q,) for q in qs], "q array<double>")
    for r, q in zip(df.select(SC.softmax(F.col("q")).alias("p")).collect(), qs):
        e = np.exp(np.clip(np.array(q) - max(q), -50, 50))
        assert r.p == pytest.approx(list(e / e.sum()))


def gate(q, conf=0.6, margin=0.15):
    p = np.exp(np.array(q) - max(q))
    p = p / p.sum()
    ranked = np.argsort(p)[::-1]
    top = max(i for i in range(3) if p[i] == p.max())
    if top != 2:
        if p[top] < conf:
            return 2, "LOW_CONFIDENCE"
        if p[top] - p[ranked[1]] < margin:
            return 2, "LOW_MARGIN"
    return top, None


def test_gate(spark):
    rng = random.Random(1)
    qs = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(300)] + [[0.0, 0.0, 5.0], [5.0, 0.0, 0.0], [0.0, math.log(3), -50.0]]
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(qs)], "i long, q0 double, q1 double, q2 double")
    got = {r.i: (r.action_code, r.uncertainty_reason) for r in D.gate_decision(df).collect()}
    assert got == {i: gate(q) for i, q in enumerate(qs)}
    strict = {r.i: r.uncertainty_reason for r in D.gate_decision(df, 0.5, 0.7).collect()}
    assert strict == {i: gate(q, 0.5, 0.7)[1] for i, q in enumerate(qs)}


def one_by_one(staff, n):
    load = {a: x for a, _, x in staff}
    cap = {a: c for a, c, _ in staff}
    out = []
    for _ in range(n):
        pool = [a for a in load if load[a] < cap[a]] or list(load)
        best = min(pool, key=lambda a: (load[a], -max(cap[a] - load[a], 0), a))
        load[best] += 1
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_routing_equals_the_one_by_one_rule(spark, seed):
    rng = random.Random(seed)
    staff = [(f"a{i}", rng.randrange(0, 9), rng.randrange(0, 14)) for i in range(rng.randrange(1, 7))]
    n = rng.choice([0, 1, 17, 90])
    reviews = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 100).alias("ts"))
    work = spark.createDataFrame(staff, "analyst_id string, capacity long, load long")
    got = [r.assigned_analyst for r in D.route_to_analysts(reviews, work).orderBy("ts", "event_id").collect()]
    assert got == one_by_one(staff, n)


def test_routing_without_staff(spark):
    work = spark.createDataFrame([], "analyst_id string, capacity long, load long")
    reviews = spark.range(3).select(F.col("id").alias("event_id"), F.col("id").alias("ts"))
    assert {r.assigned_analyst for r in D.route_to_analysts(reviews, work).collect()} == {None}


def test_routing_lists_no_more_places_than_reviews(spark):
    work = spark.createDataFrame(
        [("a", 5_000_000_000, 1), ("b", 5_000_000_000, 0), ("c", 2, 2), ("d", 4_999_999_999, 0)], "analyst_id string, capacity long, load long")
    reviews = spark.range(5).select(F.col("id").alias("event_id"), F.col("id").alias("ts"))
    got = [r.assigned_analyst for r in D.route_to_analysts(reviews, work).orderBy("ts").collect()]
    assert got == one_by_one([tuple(r) for r in work.collect()], 5)
    assert D.route_to_analysts(reviews.limit(0), work).count() == 0


def test_routing_at_any_size_of_capacity_and_load(spark):
    """Tables stay as long as reviews and staff together, and the rule holds across levels, gaps and full staff."""
    rng = random.Random(77)
    for _ in range(4):
        base = rng.choice((0, 10**9))
        staff = [(f"a{i:02d}", base + rng.choice((0, 5, 9, 10**12)), base + rng.randrange(0, 8)) for i in range(12)]
        n = rng.choice((40, 300))
        reviews = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 11).alias("ts"))
        work = spark.createDataFrame(staff, "analyst_id string, capacity long, load long")
        got = [r.assigned_analyst for r in D.route_to_analysts(reviews, work).orderBy("ts", "event_id").collect()]
        assert got == one_by_one(staff, n)


def test_gate_is_computed_once(spark):
    """A filter on what follows from the gate keeps its plan small and in generated code."""
    df = spark.range(50).selectExpr("id", "get_json_object(concat('{\"k\":', id, '}'), '$.k') + 0.5 AS k")
    df = df.selectExpr("id", "k % 7 AS q0", "k % 5 AS q1", "k % 3 AS q2")
    status = F.when(F.col("action_code") == 2, "pending").when(F.col("id") % 3 == 0, "other").otherwise(F.col("uncertainty_reason"))
    out = D.gate_decision(df).withColumn("status", status).filter(F.col("status").isin("pending", "other"))
    out = out.filter(F.col("status") != "x").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") <= 3 and plan.count("EXP") <= 8


def test_historical_reward(spark):
    df = spark.createDataFrame([(0, 0, 8.0), (1, 0, 8.0), (2, 1, 20.0), (3, 2, 3.0), (2, 0, -40.0), (1, 1, -15.0), (3, 0, -8.0), (2, 2, -12.0)], "g long, a long, want double")
    for r in df.select("want", R.historical_reward(F.col("g"), F.col("a")).alias("got")).collect():
        assert r.got == r.want
    for bad in ((0, 99), (7, 0), (None, 1)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([bad], "g long, a long").select(R.historical_reward(F.col("g"), F.col("a"))).collect()


def test_latency_and_feedback_rewards(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,), (2.01,), (80.0,), (81.0,)], "s double")
    got = [r[0] for r in df.select(R.latency_reward(F.col("s"))).collect()]
    assert got == pytest.approx([0, 0, 0, -0.201, -8, -8])
    with pytest.raises(PySparkException):
        spark.createDataFrame([(-1.0,)], "s double").select(R.latency_reward(F.col("s"))).collect()
    one = spark.createDataFrame([("failed", True, 500.0), ("executed", None, None), ("approved", False, 10.0)], "o string, c boolean, s double")
    assert [r[0] for r in one.select(R.feedback_reward(F.col("o"), F.col("c"), F.col("s"))).collect()] == [-28.0, 1.0, -16.0]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("odd", None, 1.0)], "o string, c boolean, s double").select(
            R.feedback_reward(F.col("o"), F.col("c"), F.col("s"))).collect()


def test_unknown_grade_uses_last_row_and_ties_are_optimal(spark):
    df = spark.createDataFrame([(9, 2), (0, 0), (1, 2), (2, 1)], "grade_code long, action long").withColumn("incident_id", F.lit("i"))
    scored = E.score_rewards(df)
    assert [(r.reward, r.best) for r in scored.collect()] == [(1.5, 1.5), (1.5, 1.5), (0.25, 1.5), (2.0, 2.0)]
    m = E.evaluate_policy(scored).first()
    assert (m.rows, m.incidents, m.total_reward, m.policy_optimality) == (4, 1, 5.25, 0.75)
    by = E.evaluate_by_class(scored).collect()
    assert sum(r.rows for r in by) == m.rows and sum(r.average_reward * r.rows for r in by) == m.total_reward
    assert {r.grade for r in by if r.grade_code == 9} == {"Unknown"}


def test_empty_evaluation(spark):
    scored = E.score_rewards(spark.createDataFrame([], "grade_code long, action long, incident_id string"))
    m = E.evaluate_policy(scored).first()
    assert (m.rows, m.incidents, m.average_reward, m.reward_efficiency, m.policy_optimality) == (0, 0, 0.0, 0.0, 0.0)
    stats = E.reward_stats(scored, "reward").first()
    assert (stats.mean_reward, stats.max_reward, stats["count"], stats["sum"]) == (None, None, 0, 0.0)
    assert {r.action: r.n for r in E.action_distribution(scored).collect()} == {"allow": 0, "block": 0, "human_review": 0}


def test_overrides_ignore_unknown_names():
    table = R.overridden({"Unknown": {"allow": 9}, "Nobody": {"allow": 1}, "TruePositive": {"jump": 4}})
    assert table[3][0] == 9.0 and table[2] == [-2.0, 2.0, 1.0]


def test_network_matches_numpy(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 8)), rng.normal(size=8)), (rng.normal(size=(8, 3)), rng.normal(size=3))]
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, state array<double>")
    got = np.array([[r.q0, r.q1, r.q2] for r in P.score_network(df, layers).orderBy("i").collect()])
    want = np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
    assert np.allclose(got, want, atol=1e-4)


def test_lookup_backs_off(spark):
    train = spark.createDataFrame([("a", "x", 0)] * 5 + [("a", "y", 2)] + [("b", None, 3)] * 3, "c string, s string, grade_code long")
    policy = P.fit_action_values(train, ["c", "s"], 3)
    ask = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, "z", "x")], "i long, c string, s string")
    got = {r.i: r.q0 for r in P.score_lookup(ask, policy, ["c", "s"]).collect()}
    assert got == pytest.approx({1: 1.5, 2: (5 * 1.5 - 2) / 6, 3: -1.0, 4: (7.5 - 2 - 3) / 9})


def test_version_and_compatibility(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i long, t string")
    c = spark.createDataFrame([(2, None), (1, "y")], "i long, t string")
    prints = [P.fingerprint(t).first().fingerprint for t in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]
    reg = spark.createDataFrame([("m", "dqn", 11), ("n", "dqn", 13)], "name string, algorithm string, state_dim long")
    bad = P.incompatible_entries(reg, {"algorithm": "dqn", "state_dim": 13}).collect()
    assert [(r.name, r.differs) for r in bad] == [("m", "state_dim")]


def test_apply_reviews_words(spark):
    from triagemill.constants import REVIEW_WORDS

    words = list(REVIEW_WORDS) + ["APPROVE", "maybe"]
    alerts = spark.createDataFrame([(f"A{i}", "OPEN", None, True) for i in range(len(words))], "alert_id string, status string, assigned_analyst string, requires_human_review boolean")
    reviews = spark.createDataFrame([(f"A{i}", "SA", w, "", i, i) for i, w in enumerate(words)], "alert_id string, analyst_id string, decision string, comment string, ts long, seq long")
    out = EV.apply_reviews(alerts, reviews)
    got = {r.alert_id: r.status for r in out["alerts"].collect()}
    assert [got[f"A{i}"] for i in range(len(words))] == [REVIEW_WORDS.get(w.lower(), "OPEN") for w in words]
    assert [r.reason for r in out["refused"].collect()] == ["unsupported decision"]


def test_baselines_are_compared(spark):
    """Scores equal those of the written predictions, counted by hand."""
    rng = random.Random(10)
    rows = [(i, i % 4, float(i % 4 + rng.random() * 3), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, grade_code long, a double, b double")
    got = P.compare_baselines(df.filter("id < 300"), df.filter("id >= 300"), ["b"], ["a", "b"], trees=5, depth=4, leaf=1)
    scores = {(r.feature_set, r.metric): r.value for r in got["scores"].collect()}
    for name in ("current", "expanded"):
        pairs = [(r.grade_code, r.prediction) for r in got[name].collect()]
        assert len(pairs) == 100
        f1, recall = {}, {}
        for c in range(4):
            tp, n, p = (sum(x) for x in zip(*((y == c == z, y == c, z == c) for y, z in pairs)))
            f1[c], recall[c] = 2 * tp / (n + p) if n + p else 0.0, tp / n if n else 0.0
        assert scores[name, "accuracy"] == pytest.approx(sum(y == z for y, z in pairs) / 100)
        assert scores[name, "macro_f1"] == pytest.approx(sum(f1.values()) / 4)
        assert scores[name, "true_positive_recall"] == pytest.approx(recall[2])
        assert scores[name, "unknown_f1"] == pytest.approx(f1[3])
    gate = got["gate"].first()
    assert gate.macro_f1_change == pytest.approx(scores["expanded", "macro_f1"] - scores["current", "macro_f1"])
    assert gate.macro_f1_change > 0.1
