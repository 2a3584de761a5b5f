"""Order-dependent helpers against plain Python, with a hot key and tied times."""

import random

import pytest
from pyspark.sql import functions as F

from triagemill.operators import encode as N
from triagemill.operators import ordered as O
from triagemill.operators import runstats as RS
from triagemill.operators import sequences as S
from triagemill.operators.ordered import exact_percentiles, order_blocks, positioned, ranked_values
from triagemill.session import settle


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        time = None if i % 50 == 7 else (5 if i % 4 == 0 else rng.randrange(40))  # a quarter shares one time
        out.append((key, time, i, float(rng.randrange(9))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, id long, v double").repartition(5).cache()


def order(row):
    return (row[1] is None, row[1] or 0, row[2])


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("blocks", [2, 7, 64])
def test_blocks_keep_order_and_split_ties(frame, rows, blocks):
    got = {r.id: r._block for r in order_blocks(frame, "t", "id", blocks).collect()}
    seen = [got[r[2]] for r in sorted(rows, key=order)]
    assert seen == sorted(seen)
    if blocks == 64:
        sizes = {}
        for b in got.values():
            sizes[b] = sizes.get(b, 0) + 1
        assert max(sizes.values()) < 60  # 150 rows share time 5


@pytest.mark.parametrize("blocks", [2, 16])
def test_positions_totals_maxima_following(frame, rows, blocks):
    df = positioned(frame, ["key"], "t", "id", following="v", totals={"sum_v": "v"}, maxima={"max_before": "v"}, blocks=blocks)
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        total, best = 0.0, None
        for i, r in enumerate(group):
            total += r[3]
            g = got[r[2]]
            assert (g.position, g.group_size) == (i, len(group))
            assert g.sum_v == total and g.max_before == best
            assert g.next_v == (group[i + 1][3] if i + 1 < len(group) else None)
            best = r[3] if best is None else max(best, r[3])


@pytest.mark.parametrize("kind", ["long", "decimal(30,2)"])
def test_hot_times_that_are_equal_as_doubles(spark, kind):
    """Nanoseconds: 256 of them are one double. The tie runs against the time, and one time is very frequent."""
    rng = random.Random(5)
    start = 1_704_067_200_000_000_000 if kind == "long" else 10**26
    span = 700 if kind == "long" else 10**11
    times = [start + (span // 2 if i % 4 == 0 else rng.randrange(span)) for i in range(900)] + [(1 << 63) - 1, -(1 << 63), (1 << 63) - 2]
    rows = [("hot", t, -(t % 100_003) * 1000 + i, float(i % 7)) for i, t in enumerate(times)]
    df = spark.createDataFrame([(k, str(t), i, v) for k, t, i, v in rows], "key string, t string, id long, v double")
    df = df.withColumn("t", F.col("t").cast(kind)).repartition(5)
    want = sorted(rows, key=lambda r: (r[1], r[2]))
    for keys in (["key"], []):
        made = positioned(df, keys, "t", "id", following="v", totals={"sum_v": "v"}, blocks=16)
        got = {r.id: (r.position, r.next_v, r.sum_v) for r in made.collect()}
        total = 0.0
        for i, r in enumerate(want):
            total += r[3]
            assert got[r[2]] == (i, want[i + 1][3] if i + 1 < len(want) else None, total)
    sizes = order_blocks(df, "t", "id", 64).groupBy("_block").count().agg(F.max("count")).first()[0]
    assert sizes < 90  # 225 rows share one time


def test_hot_null_key_keeps_its_rows(frame, rows):
    df = frame.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
    got = positioned(df, ["key"], "t", "id", following="v", blocks=16).filter("key is null").collect()
    want = {r[2]: i for i, r in enumerate(by_key(rows)["hot"])}
    assert {r.id: r.position for r in got} == want


def test_whole_table_numbering_is_the_same_for_any_partitioning(frame, rows):
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=order))}
    for n in (1, 9):
        got = {r.id: r.position for r in positioned(frame.repartition(n), [], "t", "id", blocks=5).collect()}
        assert got == want


def test_percentiles_and_ranks(frame, rows):
    def pct(values, q):
        values = sorted(values)
        spot = (len(values) - 1) * q
        low = int(spot)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (spot - low)

    got = {r.key: r for r in exact_percentiles(frame, ["key"], "v", {"m": 0.5, "p95": 0.95}).collect()}
    for key, group in by_key(rows).items():
        values = [r[3] for r in group]
        assert got[key].m == pytest.approx(pct(values, 0.5)) and got[key].p95 == pytest.approx(pct(values, 0.95))
    whole = ranked_values(frame, [], "v").collect()
    assert sum(r.copies for r in whole) == 600 and {r.total for r in whole} == {600}


def test_iqm_edges(spark):
    groups = {"a": [1.0, 2.0, 9.0], "b": [1.0, 2.0, 3.0, 100.0], "c": [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 50.0, 60.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, v double")
    got = {r.g: r.iqm for r in RS.iqm(df, ["g"], "v").collect()}
    assert got == {"a": 4.0, "b": 2.5, "c": 2.5}
    assert RS.iqm(df.filter("g = 'z'"), ["g"], "v").count() == 0


@pytest.mark.parametrize("gamma,longest", [(0.9, 3), (0.9, 50_000), (1.0, 4), (0.5, 1)])
def test_discounted_return(frame, rows, gamma, longest):
    df = S.discounted_return(frame, gamma, reward="v", keys=["key"], time="t", tie="id", longest=longest)
    got = {r.id: r["return"] for r in df.collect()}
    for group in by_key(rows).values():
        g = 0.0
        for r in reversed(group):
            g = r[3] + gamma * g
            assert got[r[2]] == pytest.approx(g, abs=1e-9)


def test_discounted_return_example_and_long_run(spark):
    df = spark.createDataFrame([("a", i, i, r) for i, r in enumerate([1.0, 0.0, 2.0, -1.0])], "incident_id string, ts long, event_id long, reward double")
    got = [r["return"] for r in S.discounted_return(df, 0.9).orderBy("ts").collect()]
    assert got == pytest.approx([1.891, 0.99, 1.1, -1.0])
    long = spark.range(30_000).select(F.lit("x").alias("incident_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.lit(1.0).alias("reward"))
    first = S.discounted_return(long, 0.95).filter("ts = 0").first()["return"]
    assert first == pytest.approx(20.0)  # no underflow over 30 000 steps


def test_transitions_edges(spark):
    data = [("one", 1, 1, 7.0), ("tie", 4, 3, 1.0), ("tie", 4, 2, 2.0), ("bad", None, 5, 3.0), ("bad", 9, 6, 4.0), (None, 1, 8, 0.0)]
    df = spark.createDataFrame(data, "incident_id string, ts long, event_id long, state double")
    got = {r.event_id: (r.step, r.next_state, r.done) for r in S.transitions(df).collect()}
    assert got == {1: (0, 7.0, True), 2: (0, 1.0, False), 3: (1, 1.0, True), 6: (0, 3.0, False), 5: (1, 3.0, True)}


def test_alerts_without_incident_keep_their_order(spark):
    data = [("a", 2, 1), ("a", 1, 2), (None, 5, 3), (None, 4, 5), (None, 4, 4), (None, None, 6)]
    df = spark.createDataFrame(data, "incident_id string, ts long, event_id long")
    want = {2: (0, 2), 1: (1, 2), 4: (0, 4), 5: (1, 4), 3: (2, 4), 6: (3, 4)}
    got = {r.event_id: (r.position, r.group_size) for r in S.order_incidents(df).collect()}
    assert got == want


def stop_rule(scores, delta, patience, least):
    best, best_epoch, waited = None, None, 0
    for epoch, s in enumerate(scores, 1):
        if best is None or s > best + delta:
            best, best_epoch, waited = s, epoch, 0
        else:
            waited += 1
            if epoch >= least and waited >= patience:
                return best_epoch, best, epoch, "validation_patience_exhausted"
    return best_epoch, best, len(scores), "max_epochs_reached"


def test_early_stopping(spark):
    rng = random.Random(5)
    runs = {"doc": [0.5, 0.5005, 0.52, 0.519, 0.5205, 0.53]}
    for i in range(40):
        n = rng.randrange(1, 60)
        runs[f"r{i}"] = [rng.random() * 0.2 + (j * 0.004 if i % 2 else 0) for j in range(n)]
    data = [(run, e, s) for run, xs in runs.items() for e, s in enumerate(xs, 1)]
    df = spark.createDataFrame(data, "run_id string, epoch long, score double").repartition(6)
    for delta, patience, least in ((0.001, 4, 3), (0.03, 2, 10)):
        got = {r.run_id: tuple(r)[1:] for r in RS.replay_early_stopping(df, delta, patience, least).collect()}
        assert got == {run: stop_rule(xs, delta, patience, least) for run, xs in runs.items()}


def whole_stop_rule(rows, delta, patience, least, tolerance, window):
    """The reference's loop: decline, then convergence, then patience."""
    best, best_epoch, waited = None, None, 0
    for epoch, (s, _) in enumerate(rows, 1):
        if best is None or s > best + delta:
            best, best_epoch, waited = s, epoch, 0
        else:
            waited += 1
        recent = rows[max(0, epoch - window):epoch]
        scores, rewards = [x for x, _ in recent], [y for _, y in recent if y is not None]
        if epoch < least:
            continue
        if len(scores) == len(rewards) == window:
            flat = max(scores) - min(scores) <= tolerance
            flat = flat and max(rewards) - min(rewards) <= max(tolerance, max(abs(sum(rewards) / window), 1.0) * 0.0025)
            if scores[-1] < best - delta and all(b <= a + delta * 0.25 for a, b in zip(scores, scores[1:])):
                return best_epoch, best, epoch, "persistent_validation_decline"
            if flat and all(x <= best + delta for x in scores):
                return best_epoch, best, epoch, "validation_and_policy_converged"
        if waited >= patience:
            return best_epoch, best, epoch, "validation_patience_exhausted"
    return best_epoch, best, len(rows), "max_epochs_reached"


def test_early_stopping_by_decline_and_convergence(spark):
    rng = random.Random(12)
    runs = {
        "converges": [(0.5, 1.0)] * 30, "declines": [(0.9 - i / 50, float(i)) for i in range(30)],
        "no reward": [(0.5, None if i % 3 == 0 else 1.0) for i in range(30)],
        "again": [(0.3, 1.0)] * 4 + [(0.5, 1.0)] * 26}
    for i in range(60):
        score, out = 0.5, []
        for _ in range(rng.randrange(1, 40)):
            score += rng.choice(((-0.03, -0.01, 0.002), (-0.004, 0.0, 0.004), (-0.05, 0.02, 0.05))[i % 3])
            out.append((score, rng.choice((1.0, 1.0, 1.004, None if i % 5 == 0 else 1.0))))
        runs[f"r{i}"] = out
    data = [(run, e, s, w) for run, xs in runs.items() for e, (s, w) in enumerate(xs, 1)]
    df = spark.createDataFrame(data, "run_id string, epoch long, score double, reward double").repartition(6)
    seen = set()
    for delta, patience, least in ((0.01, 8, 5), (0.01, 5, 9)):
        got = {r.run_id: tuple(r)[1:] for r in RS.replay_early_stopping(df, delta, patience, least, tolerance=0.02, window=4).collect()}
        assert got == {run: whole_stop_rule(xs, delta, patience, least, 0.02, 4) for run, xs in runs.items()}
        seen |= {x[3] for x in got.values()}
    assert len(seen) == 4


def test_early_stopping_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    runs = {f"r{i}": sorted(rng.random() for _ in range(50)) if i % 2 else [rng.random() for _ in range(9)] for i in range(6)}
    data = [(run, e, s) for run, xs in runs.items() for e, s in enumerate(xs, 1)]
    df = spark.createDataFrame(data, "run_id string, epoch long, score double")
    monkeypatch.setattr(RS, "FOLD_LIMIT", 7)
    got = {r.run_id: tuple(r)[1:] for r in RS.replay_early_stopping(df, 0.03, 2, 10).collect()}
    assert got == {run: stop_rule(xs, 0.03, 2, 10) for run, xs in runs.items()}


def test_bootstrap_small_large_and_single(spark):
    data = [("one", 1.0)] + [("few", float(i)) for i in range(6)] + [("many", float(i % 10)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in RS.bootstrap_ci(df, "g", "v", reps=400).collect()}
    assert got["one"].status == "N/A" and got["one"].lower is None
    assert 0 <= got["few"].lower < 2.5 < got["few"].upper <= 5
    assert 4.3 < got["many"].lower < 4.5 < got["many"].upper < 4.7


def test_wide_codebook_equals_plain_one(spark, monkeypatch):
    words = ["A", "Z", "_", "a", "b", "é", None, "T1059.001", "T1059.002", "T1059"] + [f"{i:05d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    usual = {r.value: r.code for r in N.fit_codebook(df, ["c"]).collect()}
    assert usual == {w: i for i, w in enumerate(sorted(w or "Unknown" for w in words))}
    monkeypatch.setattr(N, "WIDE_COLUMN", 5)
    assert {r.value: r.code for r in N.fit_codebook(df, ["c"]).collect()} == usual


def test_wide_column_with_one_beginning_is_spread(spark, monkeypatch):
    """All values begin with the same twenty bytes; ranges come from what follows."""
    monkeypatch.setattr(N, "WIDE_COLUMN", 1000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    monkeypatch.setattr(O, "settle", lambda df, label="table": seen.append((label, settle(df, label))) or seen[-1][1])
    try:
        df = spark.range(200_000).select(
            F.concat(F.lit("the-same-20-bytes-xx"), F.lpad((F.col("id") * 7919 % 200_000).cast("string"), 8, "0")).alias("c"),
            F.concat(F.lit("é"), (F.col("id") % 1500).cast("string")).alias("d"))
        book = N.fit_codebook(df, ["c", "d"])
        assert book.filter("column = 'c' and code <> cast(substr(value, 21) as long)").isEmpty()
        got = {r.value: r.code for r in book.filter("column = 'd'").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {w: i for i, w in enumerate(sorted(f"é{i}" for i in range(1500)))}
    sizes = [r["count"] for r in next(t for label, t in seen if label == "ranges").groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / 4
