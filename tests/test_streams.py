"""Streams over several files: same rows as in batch, late rows, carried loads."""

import time

import pytest
from pyspark.sql import functions as F

from triagemill.operators.decide import gate_decision
from triagemill.operators.events import current_alert_state
from triagemill.plans.views import Views, activity_from, alerts_from
from triagemill.streaming import flows as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in four files by time, in the order of their modification times."""
    path = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = events.filter((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    return str(path), events.schema


def source(spark, folder):
    path, schema = folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_decisions_carry_loads_across_batches(spark, folder):
    from test_decide import one_by_one

    staff = [("a", 30, 2), ("b", 50, 0), ("c", 10, 11)]
    work = spark.createDataFrame(staff, "analyst_id string, capacity long, load long")
    scored = alerts_from(source(spark, folder)).withColumn("cycle_id", F.lit("C"))
    out = ST.decide_stream(scored, work)
    assert out.count() == 1000
    got = [r.assigned_analyst for r in out.filter("requires_human_review").orderBy("ts", "event_id").collect()]
    assert got == one_by_one(staff, len(got))
    batch = gate_decision(Views(spark, SF).alerts()).filter("action_code = 2").count()
    assert len(got) == batch


def test_state_stream_equals_batch(spark, folder):
    live = ST.current_state_stream(activity_from(alerts_from(source(spark, folder))))
    batch = current_alert_state(Views(spark, SF).activity())
    names = ["alert_id", "status", "assigned_analyst", "last_human_decision", "updated_at"]
    assert sorted(map(tuple, live.select(names).collect()), key=repr) == sorted(map(tuple, batch.select(names).collect()), key=repr)


def test_windows_equal_batch(spark, folder):
    log = activity_from(alerts_from(source(spark, folder))).filter("action = 'AGENT_INFERENCE'")
    live = ST.drain(ST.windowed_rates(log, "6 hours", delay="2 days"), mode="update", keys=["window_start", "window_end"])
    batch = ST.windowed_rates(Views(spark, SF).activity().filter("action = 'AGENT_INFERENCE'"), "6 hours")
    assert sorted(map(tuple, live.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_repeated_and_late_alerts_are_dropped(spark, tmp_path):
    schema = "alert_id string, ts timestamp, category string, threat_family string, suspicion string"
    files = [
        [("A1", "2024-01-01 00:00:00"), ("A1", "2024-01-01 00:00:05"), ("A2", "2024-01-02 00:00:00"), ("  ", "2024-01-02 00:00:00")],
        [("A2 ", "2024-01-02 01:00:00"), ("A3", "2024-01-02 01:00:00")],
        [("A4", "2023-06-01 00:00:00"), ("A5", "2024-01-02 02:00:00")],  # A4 is far behind the watermark
    ]
    for rows in files:
        data = spark.createDataFrame([(*r, "c", None, None) for r in rows], "alert_id string, ts string, category string, threat_family string, suspicion string")
        data.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ST.drain(ST.ingest_alerts(stream, "2 hours")).collect()
    assert sorted(r.alert_id for r in got) == ["A1", "A2", "A3", "A5"]
    assert {r.title for r in got} == {"c / Unknown"} and {r.severity for r in got} == {"medium"}


def test_latency_stream_over_files(spark, folder):
    one = activity_from(alerts_from(source(spark, folder))).filter("action = 'ALERT_IMPORTED'")
    two = activity_from(alerts_from(source(spark, folder))).filter("action = 'AGENT_INFERENCE'")
    got = ST.drain(ST.latency_stream(one, two, "3 days", "1 hour"))
    assert got.count() == 980
    assert got.filter("latency < 0 or latency >= 1").count() == 0


def requests_in(spark, path, rows):
    data = spark.createDataFrame([(p, t) for p, t in rows], "path string, ts string")
    data.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_silent_component_goes_down_by_itself(spark, tmp_path):
    from triagemill.streaming import liveness as LV

    path, log = str(tmp_path / "in"), []
    requests_in(spark, path, [("/a/1", "2024-01-01 00:00:00"), ("/a/2", "2024-01-01 00:00:09"), ("/other", "2024-01-01 00:00:00"), ("/b", None)])
    source = spark.readStream.schema("path string, ts timestamp").parquet(path)

    def put(batch, number):
        log.extend((r.component, r.status, r.request_count, str(r.last_seen)) for r in batch.collect())

    def wait(row, seconds=90):
        end = time.time() + seconds
        while row not in log and time.time() < end:
            time.sleep(0.3)
        assert row in log, log

    query = LV.watch_components(source, [("a", "/a"), ("b", "/b"), ("ghost", "/g")], put, 6.0, "1 second")
    try:
        wait(("a", "up", 2, "2024-01-01 00:00:09"))
        wait(("a", "down", 2, "2024-01-01 00:00:09"))  # no request has come since
        wait(("ghost", "down", 0, "None"))  # never seen
        requests_in(spark, path, [("/a/3", "2024-01-01 00:01:00")])
        wait(("a", "up", 3, "2024-01-01 00:01:00"))
        wait(("a", "down", 3, "2024-01-01 00:01:00"))
    finally:
        query.stop()
    assert [x[1] for x in log if x[0] == "a"] == ["up", "down", "up", "down"]
    assert [x[1:3] for x in log if x[0] == "b"] == [("down", 0)]


def test_state_is_compacted(spark, folder, tmp_path):
    from triagemill.sources.commits import Versions

    path = str(tmp_path / "state")
    log = activity_from(alerts_from(source(spark, folder)))
    live = ST.current_state_stream(log, path, compact_every=1)
    names = ["alert_id", "status", "assigned_analyst", "last_human_decision", "updated_at"]
    batch = sorted(map(tuple, current_alert_state(Views(spark, SF).activity()).select(names).collect()), key=repr)
    assert sorted(map(tuple, live.select(names).collect()), key=repr) == batch
    versions = Versions(spark, f"{path}/base")
    assert [versions.number(x) for x in versions.committed()] == [2, 3]
    assert Versions(spark, path).names("rows") == ["batch=3"]  # older deltas lie in the bases
    assert spark.read.parquet(versions.folder(versions.newest())).count() == len(batch)
    # a base that was written but not committed is not read
    spark.range(1).write.parquet(versions.folder(versions.fresh(9)))
    assert ST.read_state(spark, path).count() == len(batch)
