"""Sources, sinks, contracts, splits, encoding edges."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from triagemill.functions import missing as M
from triagemill.operators import clean as C
from triagemill.operators import encode as N
from triagemill.operators import quality as Q
from triagemill.operators import soc
from triagemill.operators import splits as SP
from triagemill.sources import alerts as SA
from triagemill.sources import sinks as SK
from triagemill.sources.runs import read_run_metrics


def test_header_must_match(spark, tmp_path):
    good = ",".join(SA.RAW_COLUMNS)
    (tmp_path / "good.csv").write_text(good + "\n" + ",".join(str(i) for i in range(13)) + "\n")
    (tmp_path / "bad.csv").write_text(good.replace("Category", "Kategory") + "\n" + ",".join("x" * 13) + "\n")
    assert SA.read_alerts(spark, str(tmp_path / "good.csv")).first().LastVerdict == "12"
    with pytest.raises(Exception, match="header does not conform"):
        SA.read_alerts(spark, str(tmp_path / "bad.csv")).collect()


def test_contract(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, f double")
    assert SA.load_contract(df, ["id"], ["id"]).count() == 2
    for required, features, rows in ((["gone"], [], df), (["id"], ["f"], df), (["id"], [], df.limit(0))):
        with pytest.raises(ValueError):
            SA.load_contract(rows, required, features)
    assert SA.same_columns(df, df, "f", "id") and not SA.same_columns(df, df.select("f", "id"), "f", "id")
    with pytest.raises(ValueError):
        SA.same_columns(df, df.drop("f"), "f", "id")


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    assert SK.write_processed(df, str(tmp_path / "p")) == 5
    with pytest.raises(RuntimeError):
        SK.write_processed(df.filter("id > 9"), str(tmp_path / "q"))
    with pytest.raises(FileNotFoundError):
        SK.read_codebook(spark, str(tmp_path / "none"))


def test_run_metrics(spark, tmp_path):
    (tmp_path / "r1.json").write_text(
        '{"config": {"run_id": "r1", "algorithm": "dqn"}, "metrics": [{"epoch": 1, "loss": 0.5, "average_reward": 0.1,'
        ' "sample_action_distribution": {}, "action_counts": {"allow": 3}}, {"loss": 1.0}, {"epoch": 2, "policy_reward": 0.4, "rows": 7}]}')
    (tmp_path / "plain.json").write_text('{"metrics": [{"epoch": 3, "loss": 0.25}]}')
    got = {(r.run_id, r.epoch): r for r in read_run_metrics(spark, str(tmp_path)).collect()}
    assert set(got) == {("r1", 1), ("r1", 2), ("plain", 3)}
    assert got["r1", 1].action_distribution == {"allow": 3} and got["r1", 1].policy_reward == 0.1
    assert got["r1", 2].rows_seen == 7


def test_lineage_counts_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12345")
    got = {r.role: (r.exists, r.bytes) for r in SA.file_lineage(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}).collect()}
    assert got == {"A": (True, 5), "B": (False, None)}


def test_missing_tokens(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("nan", "x"), ("NaN", None), (" x ", "y")], "a string, b string")
    assert [r.o for r in M.first_present(df, "o", ["zz", "a", "b"], trim=True).collect()] == ["x", "x", "x", None, "x"]


def test_event_times(spark):
    texts = ["1700000000", "1700000000.5", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20+01:00", "2023-11-14 22:13:20", "soon", "", None, "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in M.parse_event_time(df, "t", "at").select(F.unix_micros("at").alias("m")).collect()]
    base = 1_700_000_000_000_000
    assert got == [base, base + 500_000, base, base - 3_600_000_000, base, None, None, None, None]
    assert M.parse_event_time(df, "t", "at", default_epoch=True).filter("at is null").count() == 0


def test_minmax_and_zscore_edges(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(5.0, 9.0)], "x double, c double")
    r = N.apply_minmax(test, N.fit_minmax(train, ["x", "c"]), ["x", "c"]).first()
    assert (r.x_scaled, r.c_scaled) == (2.0, 0.0)
    z = N.apply_zscore(test, N.fit_zscore(train, ["x", "c"]), ["x", "c"]).first()
    assert (z.x_z, z.c_z) == (3.0, 4.0)


def test_codes_of_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    book = N.fit_codebook(train, ["c"])
    assert {r.value: r.code for r in book.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    assert [r.c_code for r in N.apply_codebook(test, book, ["c"]).collect()] == [1, -1, 0]
    assert sorted(r.c_code for r in N.apply_codebook_bucketed(test, book, ["c"]).collect()) == pytest.approx([0, 1 / 3, 1])
    with pytest.raises(ValueError):
        N.apply_codebook_bucketed(test.select(F.lit(True).alias("c")), book, ["c"])
    numbers = N.apply_codebook_bucketed(spark.createDataFrame([(2.0,)], "c double"), book, ["c"])
    assert numbers.first().c_code == pytest.approx(2 / 3)


def test_shuffled_codebook_join_equals_broadcast(spark, monkeypatch):
    train = spark.createDataFrame([(f"v{i % 40}",) for i in range(200)], "c string")
    book = N.fit_codebook(train, ["c"])
    a = sorted(r.c_code for r in N.apply_codebook(train, book, ["c"]).collect())
    monkeypatch.setattr(N, "BROADCAST_ROWS", 1)
    assert sorted(r.c_code for r in N.apply_codebook(train, book, ["c"]).collect()) == a


def test_recovered_codes_must_be_one_to_one(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "a")], "id long, c string")
    coded = spark.createDataFrame([(1, 0), (2, 1)], "id long, c_code long")
    with pytest.raises(ValueError):
        N.require_one_to_one(N.recover_codebook(raw, coded, "id", "c"))


def test_state_needs_all_features(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(ValueError):
        N.assemble_state(df, ["a", "z"])
    with pytest.raises(PySparkException):
        N.assemble_state(df, ["a", "b"]).collect()


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(4000).select((F.col("id") % 700).cast("string").alias("incident_id"))
    parts = SP.incident_split(df, 0.8, 1)
    report = {r.split: r for r in SP.split_report(parts).collect()}
    assert sum(r.rows for r in report.values()) == 4000 and sum(r.incidents for r in report.values()) == 700
    assert {r.shared_incidents for r in report.values()} == {0}
    exact = SP.incident_split_exact(df, 0.8, 1)
    assert exact.filter("split = 'train'").count() == 560 and exact.count() == 700
    again = {r.incident_id: r.split for r in SP.incident_split_exact(df.repartition(7), 0.8, 1).collect()}
    assert again == {r.incident_id: r.split for r in exact.collect()}
    assert SP.clamp_ratio(0.1) == 0.5 and SP.clamp_ratio(1.0) == 0.95
    with pytest.raises(ValueError):
        SP.require_disjoint(SP.split_overlap({"a": df, "b": df}))


def test_counts_reconcile(spark):
    report = C.expect_count({"a": spark.range(80), "b": spark.range(79)}, 80)
    assert [(r.stage, r.matches) for r in report.orderBy("step").collect()] == [("a", True), ("b", False)]
    with pytest.raises(ValueError):
        C.require_counts(report)


def test_no_logged_action_is_refused(spark):
    with pytest.raises(ValueError):
        C.require_logged_action(C.canonical_columns(spark.range(1)))


def test_reports_on_empty_tables(spark):
    none = spark.createDataFrame([], "y long, p long")
    assert {r.f1 for r in Q.class_report(none, "y", "p").collect()} == {0.0}
    audit = Q.audit_split(none).first()
    assert (audit.rows, audit.missing, audit.duplicates) == (0, 0, 0)
    timed = spark.createDataFrame([], "latency double, response double")
    row = soc.decision_latency(timed).first()
    assert (row["count"], row["p95_seconds"], row["status"]) == (0, None, "N/A")


def test_scan_reads_only_what_it_needs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = SA.scan_pruned(df, ["l_quantity"], "l_orderkey", "l_linenumber").filter("l_linenumber = 3")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text
    assert "l_shipdate" not in text


def test_snapshot_is_whole_at_any_time(spark, tmp_path):
    from triagemill.sources import sinks
    from triagemill.sources.commits import Versions

    path, schema = str(tmp_path / "metrics"), "epoch long, score double"
    with pytest.raises(FileNotFoundError):
        sinks.read_metrics_snapshot(spark, path, schema)
    rows = lambda n, v: spark.range(n).select(F.col("id").alias("epoch"), F.lit(v).alias("score"))
    sinks.write_metrics_snapshot(rows(3, 0.5), path)
    begun = sinks.read_metrics_snapshot(spark, path, schema)
    seen = []

    def look(batches):  # runs while the next snapshot is being written, and fails half-way
        for i, b in enumerate(batches):
            yield b
            raise RuntimeError("half-way")

    broken = rows(4, 9.0).repartition(4).mapInArrow(look, schema)
    with pytest.raises(Exception, match="half-way"):
        sinks.write_metrics_snapshot(broken, path)
    seen.append(sorted(map(tuple, sinks.read_metrics_snapshot(spark, path, schema).collect())))
    # written in whole but not committed
    rows(5, 1.0).write.json(Versions(spark, path).folder(Versions(spark, path).fresh()))
    seen.append(sorted(map(tuple, sinks.read_metrics_snapshot(spark, path, schema).collect())))
    assert seen == [[(0, 0.5), (1, 0.5), (2, 0.5)]] * 2
    sinks.write_metrics_snapshot(rows(2, float("inf")), path)
    assert sorted(map(tuple, sinks.read_metrics_snapshot(spark, path, schema).collect())) == [(0, None), (1, None)]
    assert begun.count() == 3  # a reader that began before is not disturbed
    for v in (1.0, 2.0, 3.0):
        sinks.write_metrics_snapshot(rows(1, v), path)
    assert len(Versions(spark, path).committed()) == 2
    assert [r.score for r in sinks.read_metrics_snapshot(spark, path, schema).collect()] == [3.0]


def test_one_hot_pools_rare_and_leaves_unseen_empty(spark, monkeypatch):
    monkeypatch.setattr(N, "WIDE_COLUMN", 2)  # the ranks of wide columns come from ranges
    rows = [("b", 1.0), ("b", 2.0), ("a", 3.0), ("a", 0.0), (None, 1.0), (None, 1.0), ("once", 5.0), ("lone", 6.0)]
    train = spark.createDataFrame([(i, c, f"v{i % 2}", x + i * 1000) for i, (c, x) in enumerate(rows * 1)], "i long, c string, d string, x double")
    train = train.withColumn("x", F.col("x") + 0.25)
    test = spark.createDataFrame([(0, "a", "v1", 7.0), (1, "never", "v0", 0.0), (2, "lone", "never", 1.0), (3, None, "v1", 2.0)], "i long, c string, d string, x double")
    from pyspark.ml.functions import vector_to_array

    monkeypatch.setattr(N, "categorical_features", lambda df, names, limit=100: ["c", "d"])
    got_train, got = N.one_hot(train, test, ["c", "d", "x"])
    cells = {r.i: r.v for r in got.select("i", vector_to_array("features").alias("v")).collect()}
    # Unknown, a, b, the pool of once and lone; v0, v1; x
    assert cells == {0: [0, 1, 0, 0, 0, 1, 7.0], 1: [0, 0, 0, 0, 1, 0, 0.0], 2: [0, 0, 0, 1, 0, 0, 1.0], 3: [1, 0, 0, 0, 0, 1, 2.0]}
    assert got_train.count() == 8 and set(got_train.columns) == {"i", "c", "d", "x", "features"}
