"""The live operators on streams; each gives the same rows as its batch form."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.operators.clean import alert_headline
from triagemill.operators.decide import decision_record, gate_decision, route_to_analysts
from triagemill.operators.events import fold_deltas, merge_deltas, state_changes, state_delta
from triagemill.operators.joins import route_by_prefix
from triagemill.operators.soc import seconds_between
from triagemill.session import scratch_path
from triagemill.sources.commits import Versions


def drain(
    stream: DataFrame, mode: str = "append", keys: Sequence[str] = (),
    write: Callable[[DataFrame, int, str], None] | None = None, path: str | None = None,
) -> DataFrame:
    """Run a stream over what is there and give its sink as a table.

    Each micro-batch overwrites its own folder, so a repeated batch is written
    once. For update mode ``keys`` pick the newest version of each row.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    _run(stream, mode, write or _put, path)
    names = stream.columns
    rows = spark.read.option("recursiveFileLookup", False).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "append" or not keys:
        return rows.drop("batch")
    others = [c for c in names if c not in keys]
    newest = F.max_by(F.struct(*others), F.col("batch")).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def _run(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None], path: str) -> None:
    def put(batch: DataFrame, number: int) -> None:
        write(batch, number, path)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(put)
        .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def _put(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")


def ingest_alerts(stream: DataFrame, delay: str = "1 day", key: str = "alert_id", time: str = "ts") -> DataFrame:
    """Arriving alerts: valid unique ids, headline, waiting for inference.

    Repeated ids are dropped while the watermark remembers them, so the state
    is bounded by the delay.
    """
    valid = stream.filter(F.trim(F.col(key)) != "").withColumn(key, F.trim(F.col(key)))
    unique = valid.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return alert_headline(unique).withColumns({
        "status": F.lit("WAITING_INFERENCE"), "agent_status": F.lit("WAITING_INFERENCE"),
        "requires_human_review": F.lit(False)})


def imported_events(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "alert_id", F.lit(0).cast("long").alias("seq"), F.lit("system").alias("actor"),
        F.lit("ALERT_IMPORTED").alias("action"), "ts")


def decide_stateless(stream: DataFrame, version: str = "v1", algorithm: str = "lookup") -> DataFrame:
    """Gated decisions of a scored stream, row by row; no state, no shuffle."""
    return decision_record(gate_decision(stream), version, algorithm, F.col("cycle_id"))


def decide_stream(stream: DataFrame, workload: DataFrame, path: str | None = None) -> DataFrame:
    """Gated and routed decisions per micro-batch.

    After each batch the loads are written beside the decisions; the next batch
    starts from them, so its cost does not grow with the history, and a
    repeated batch starts from the same loads again.
    """
    def write(batch: DataFrame, number: int, folder: str) -> None:
        spark = batch.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            target = f"{folder}/{name}/batch={number}"
            df.write.mode("overwrite").parquet(target)
            return spark.read.schema(df.schema).parquet(target)

        records = stored(decide_stateless(batch), "staged")
        loads = workload.select("analyst_id", "capacity", "load")
        if number > 0:
            loads = spark.read.schema(loads.schema).parquet(f"{folder}/loads/batch={number - 1}")
        routed = route_to_analysts(records.filter("requires_human_review").drop("assigned_analyst"), loads).drop("position")
        others = records.filter("not requires_human_review").withColumn("assigned_analyst", F.lit(None).cast("string"))
        done = stored(routed.unionByName(others.select(*routed.columns)), "rows")
        added = done.filter(F.col("assigned_analyst").isNotNull()).groupBy(
            F.col("assigned_analyst").alias("analyst_id")).agg(F.count(F.lit(1)).alias("_more"))
        total = (F.col("load") + F.coalesce("_more", F.lit(0))).alias("load")
        stored(loads.join(added, "analyst_id", "left").select("analyst_id", "capacity", total), "loads")

    return drain(stream, write=write, path=path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest status, analyst and human decision per alert: the newest base folded with the deltas behind it."""
    return fold_deltas(_state_parts(spark, path, Versions(spark, f"{path}/base").newest()))


def _state_parts(spark: SparkSession, path: str, base: str | None, till: int | None = None) -> DataFrame:
    """Base and deltas of later batches, each a delta per alert."""
    deltas = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    later = F.col("batch") > Versions.number(base)
    deltas = deltas.filter(later if till is None else later & (F.col("batch") <= till)).drop("batch")
    return deltas.unionByName(spark.read.parquet(f"{path}/base/{base}")) if base else deltas


def current_state_stream(events: DataFrame, path: str | None = None, compact_every: int = 16) -> DataFrame:
    """Latest status, analyst and human decision per alert.

    Each micro-batch writes the deltas of its alerts. Every ``compact_every`` batches they are merged with the base
    into a new base with one row per alert, so a read costs the live rows and at most so many deltas. A base counts
    from its commit on and a repeated batch makes an equal one; deltas and bases go when they lie behind the two
    newest bases, so that readers that have begun are not disturbed. The state is the table; executors keep none.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "state")

    def write(batch: DataFrame, number: int, folder: str) -> None:
        _put(state_delta(batch), number, folder)
        if (number + 1) % compact_every:
            return
        session = batch.sparkSession
        bases, files = Versions(session, f"{folder}/base"), Versions(session, folder)
        # a repeated batch starts from the base before its own
        older = [b for b in bases.committed() if bases.number(b) < number]
        name = bases.fresh(number)
        merge_deltas(_state_parts(session, folder, (older or [None])[-1], number)).write.parquet(bases.folder(name))
        bases.commit(name)
        bases.keep_newest(2)
        done = bases.number((older or [None])[-1])
        for old in files.names("rows"):
            if old.startswith("batch=") and int(old.removeprefix("batch=")) <= done:
                files.remove(f"rows/{old}")

    _run(state_changes(events), "append", write, path)
    return read_state(spark, path)


def latency_stream(imports: DataFrame, inferences: DataFrame, delay: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Import joined with its inference; both sides are dropped after the interval."""
    left = imports.select("alert_id", F.col("ts").alias("received")).withWatermark("received", delay)
    right = inferences.select(F.col("alert_id").alias("_id"), F.col("ts").alias("decided_at"), "decided").withWatermark("decided_at", delay)
    on = (
        (F.col("alert_id") == F.col("_id")) & (F.col("decided_at") >= F.col("received"))
        & (F.col("decided_at") <= F.col("received") + F.expr(f"INTERVAL {within}")))
    return left.join(right, on).select(
        "alert_id", "decided", seconds_between(F.col("received"), F.col("decided_at")).alias("latency"))


def windowed_rates(decisions: DataFrame, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Alerts, action counts and automation share per tumbling or sliding window."""
    action = F.col("decided")
    n = decisions.withWatermark("ts", delay).groupBy(F.window("ts", width, slide or width).alias("w")).agg(
        F.count(F.lit(1)).alias("alerts"), *[F.count_if(action == a).alias(f"n_{a}") for a in ("allow", "block", "human_review")])
    return n.select(
        F.unix_micros("w.start").alias("window_start"), F.unix_micros("w.end").alias("window_end"), "alerts",
        "n_allow", "n_block", "n_human_review",
        F.try_divide(F.col("n_allow") + F.col("n_block"), F.col("alerts")).alias("automation_share"))


def component_activity(requests: DataFrame, components: Sequence[tuple[str, str]]) -> DataFrame:
    """Last request and request count per component; batch, or stream in update mode."""
    routed = route_by_prefix(requests, components).filter(F.col("component").isNotNull())
    return routed.groupBy("component").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("request_count"))


def component_liveness(
    activity: DataFrame, components: Sequence[tuple[str, str]], now, timeout_s: float = 15.0,
) -> DataFrame:
    """Every component with age and status: unknown before the first request, down after the timeout."""
    spark = activity.sparkSession
    rows = ", ".join(f"({i}L, '{name}', '{prefix}')" for i, (name, prefix) in enumerate(components))
    known = spark.sql(f"SELECT * FROM VALUES {rows} AS t(ordinal, component, prefix)")
    age = seconds_between(F.col("last_seen"), now)
    status = F.when(F.col("last_seen").isNull(), "unknown").when(age > timeout_s, "down").otherwise("up")
    return known.join(activity, "component", "left").select(
        "ordinal", "component", "prefix", F.coalesce("request_count", F.lit(0)).alias("request_count"),
        age.alias("age_seconds"), status.alias("status"))
