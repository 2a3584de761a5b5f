"""Event rows: first events, decision events, reviews, cycles, appended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.operators.clean import review_status
from triagemill.operators.joins import last_per_key
from triagemill.operators.ordered import positioned


def first_event(events: DataFrame, action: str | None = None, prefix: str | None = None) -> DataFrame:
    """Earliest event of one kind, or of a name prefix, per alert."""
    wanted = events.filter(F.col("action") == action if action else F.col("action").startswith(prefix))
    row = F.min(F.struct("ts", "seq", "action", "actor"))
    return wanted.groupBy("alert_id").agg(row.alias("_r")).select("alert_id", "_r.ts", "_r.action", "_r.actor")


def apply_reviews(alerts: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """Fold reviews and assignments into the alerts.

    ``reviews`` has alert_id, analyst_id, decision, comment, ts and seq; the
    decision ``assign`` only changes the analyst. Gives the new ``alerts``, the
    ``events`` to append and the ``refused`` reviews with the reason.
    """
    word = F.lower(F.trim("decision"))
    marked = reviews.withColumns({"status": review_status(F.col("decision")), "_assign": word == "assign"})
    sound = marked.filter(F.col("status").isNotNull() | F.col("_assign"))
    known = alerts.select("alert_id")
    valid = sound.join(known, "alert_id", "left_semi")
    refused = marked.filter(F.col("status").isNull() & ~F.col("_assign")).withColumn(
        "reason", F.lit("unsupported decision"))
    lost = sound.join(known, "alert_id", "left_anti").withColumn("reason", F.lit("unknown alert"))
    order = F.struct("ts", "seq")
    last = valid.groupBy("alert_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("_status"),
        F.max_by("analyst_id", order).alias("_analyst"), F.max("ts").alias("_at"),
        F.bool_or(F.col("status").isNotNull()).alias("_reviewed"))
    joined = alerts.join(last, "alert_id", "left")
    changed = joined.withColumns({
        "status": F.coalesce("_status", "status"), "assigned_analyst": F.coalesce("_analyst", "assigned_analyst"),
        "requires_human_review": F.col("requires_human_review") & ~F.coalesce("_reviewed", F.lit(False)),
        "reviewed_at": F.col("_at")}).drop("_status", "_analyst", "_at", "_reviewed")
    events = valid.select(
        "alert_id", "seq", "ts", F.when(F.col("_assign"), "SA").otherwise(F.col("analyst_id")).alias("actor"),
        F.when(F.col("_assign"), "ASSIGNED").otherwise(F.concat(F.lit("HUMAN_"), "status")).alias("action"),
        F.struct("analyst_id", "comment", word.alias("action")).alias("details"))
    return {"alerts": changed, "events": events, "refused": refused.unionByName(lost)}


def state_changes(events: DataFrame) -> DataFrame:
    """What each event sets: status, analyst, human decision (null = leaves it)."""
    action = F.col("action")
    person = action.startswith("HUMAN_") & (action != "HUMAN_REVIEW_ROUTED")
    review = F.when(person, F.substr(action, F.lit(7)))
    status = (
        F.when(action == "ALERT_IMPORTED", "WAITING_INFERENCE")
        .when(action == "HUMAN_REVIEW_ROUTED", "HUMAN_REVIEW_PENDING")
        .when(action == "AGENT_INFERENCE", F.when(F.col("decided") == "allow", "MODEL_ALLOWED")
              .when(F.col("decided") == "block", "MODEL_BLOCKED").otherwise("HUMAN_REVIEW_PENDING"))
        .when(person, review)
    )
    analyst = F.when(person, F.col("actor"))
    if "details" in events.columns:  # an assignment or a routing names the analyst there
        named = F.col("details")["analyst_id"]
        analyst = F.when(action.isin("ASSIGNED", "HUMAN_REVIEW_ROUTED"), named).otherwise(analyst)
    return events.withColumns({"_status": status, "_analyst": analyst, "_human": review})


STATE_FIELDS = {"_status": "status", "_analyst": "assigned_analyst", "_human": "last_human_decision"}


def state_delta(changes: DataFrame) -> DataFrame:
    """Per alert, the latest setting of each field together with its time and number.

    Deltas can be folded again in any grouping, so they may be taken per batch.
    """
    latest = [
        F.max(F.when(F.col(name).isNotNull(), F.struct("ts", "seq", F.col(name).alias("v")))).alias(out)
        for name, out in STATE_FIELDS.items()]
    return changes.groupBy("alert_id").agg(*latest, F.max("ts").alias("updated_at"))


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """One delta per alert from any number of deltas, in any order and grouping."""
    return deltas.groupBy("alert_id").agg(*[F.max(c).alias(c) for c in (*STATE_FIELDS.values(), "updated_at")])


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """One row per alert from any number of deltas."""
    t = merge_deltas(deltas)
    return t.select("alert_id", *[F.col(f"{c}.v").alias(c) for c in STATE_FIELDS.values()], "updated_at")


def current_alert_state(events: DataFrame) -> DataFrame:
    """One row per alert from its events; folded map-side."""
    t = state_delta(state_changes(events))
    return t.select("alert_id", *[F.col(f"{c}.v").alias(c) for c in STATE_FIELDS.values()], "updated_at")


def cycle_counts(alerts: DataFrame, reviews: DataFrame, activity: DataFrame) -> DataFrame:
    """Alerts, reviews and events per cycle, zero when a cycle has none."""
    parts = None
    for kind, df in (("alert_count", alerts), ("review_count", reviews), ("activity_count", activity)):
        one = df.select("cycle_id", F.lit(kind).alias("_kind"))
        parts = one if parts is None else parts.unionByName(one)
    kinds = ("alert_count", "review_count", "activity_count")
    return parts.groupBy("cycle_id").agg(*[F.count_if(F.col("_kind") == k).alias(k) for k in kinds])


def archive_cycle(alerts: DataFrame, reviews: DataFrame, activity: DataFrame, path: str) -> DataFrame:
    """Write the three tables partitioned by cycle, and give the counts of what was written.

    Dynamic overwrite replaces only the cycles at hand, so a retry is harmless.
    """
    spark = alerts.sparkSession
    for name, df in (("alerts", alerts), ("reviews", reviews), ("activity", activity)):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle_id")
         .parquet(f"{path}/{name}"))
    kept = {
        name: spark.read.schema(df.schema).parquet(f"{path}/{name}").select("cycle_id")
        for name, df in (("alerts", alerts), ("reviews", reviews), ("activity", activity))}
    return cycle_counts(kept["alerts"], kept["reviews"], kept["activity"])


def start_cycle(alerts: DataFrame, cycle_id: str, reason: str) -> DataFrame:
    """Stamp a fresh batch of alerts as the new active cycle."""
    return alerts.withColumns({
        "cycle_id": F.lit(cycle_id), "cycle_reason": F.lit(reason), "cycle_started_at": F.current_timestamp(),
        "status": F.lit("WAITING_INFERENCE"), "agent_status": F.lit("WAITING_INFERENCE")})


def append_with_ids(existing: DataFrame, batch: DataFrame, time: str, tie: str) -> DataFrame:
    """The batch with ids that continue from the current maximum, in (time, tie) order."""
    start = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
    numbered = positioned(batch, [], time, tie)
    return numbered.withColumn("id", (F.col("position") + 1 + start).cast("long")).drop("position", "group_size")


def upsert_dimension(existing: DataFrame, batch: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """Insert or replace by key; of several batch rows of a key the last one, by ``ordinal`` or by place, counts."""
    place = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    last = last_per_key(batch.withColumn("_place", place), key, "_place").select(*batch.columns)
    batch = last.unionByName(batch.filter(F.col(key).isNull()))
    kept = existing.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table and their total; a Parquet count reads footers only."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        parts = one if parts is None else parts.unionByName(one)
    total = parts.agg(F.sum("rows").alias("rows")).select(F.lit("TOTAL").alias("table"), "rows")
    return parts.unionByName(total)


def pipeline_log_row(stats: DataFrame, kind: str, path: str) -> DataFrame:
    """A log row of one import from its missing-value statistics."""
    return stats.select(
        F.lit(kind).alias("type"), "rows", "columns", "missing", F.lit(path).alias("path"),
        F.current_timestamp().alias("logged_at"))
