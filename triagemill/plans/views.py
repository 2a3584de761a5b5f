"""Alert-shaped projections of the given tables.

Every view is a plain projection (plus unions for the event log), so filters
and column pruning pass through to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.constants import ANALYSTS, GRADES
from triagemill.operators.decide import gate_decision
from triagemill.operators.ordered import positioned
from triagemill.session import settle

SPLIT_TIME = "2024-01-21"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, names: list) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def alerts_from(events: DataFrame) -> DataFrame:
    """Batch or streaming events to alerts."""
    base = events.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    k, e, u = F.col("k"), F.col("event_id"), F.col("user_id")

    def q(m: int) -> Column:
        return ((e * m + k) % 100).cast("double") / 50 - 1

    return base.select(
        F.concat(F.lit("A"), e.cast("string")).alias("alert_id"),
        e.alias("event_id"),
        F.concat(u.cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("incident_id"),
        u.alias("user_id"),
        "ts", "k", "value",
        F.col("event_type").alias("category"),
        F.when(k % 10 != 0, F.concat(F.lit("T"), (k + 1000).cast("string"))).alias("mitre"),
        (k % 4).alias("grade_code"),
        pick(k % 4, GRADES).alias("grade"),
        pick(k % 3, ["Escalated", "Closed", None]).alias("action_grouped"),
        F.when(k % 5 != 0, F.concat(F.lit("act"), (k % 5).cast("string"))).alias("action_granular"),
        F.concat(F.lit("E"), (u % 28).cast("string")).alias("entity_type"),
        F.when(e % 2 == 0, "Related").otherwise("Impacted").alias("evidence_role"),
        F.concat(u.cast("string"), F.lit(":"), k.cast("string")).alias("threat_family"),
        F.concat(F.lit("OS"), (u % 4).cast("string")).alias("os_family"),
        F.when(F.col("value") < 20, "Low").when(F.col("value") < 60, "Medium").otherwise("High").alias("suspicion"),
        pick(k % 6, ["Benign", "Unknown", "Malicious", "Suspicious", None, "NoThreats"]).alias("verdict"),
        (F.col("value") / 10).alias("processing_s"),
        q(7).alias("q0"), q(13).alias("q1"), q(29).alias("q2"),
        (F.col("ts") < F.lit(SPLIT_TIME).cast("timestamp")).alias("is_train"),
    )


def gate_columns(alerts: DataFrame) -> DataFrame:
    """Gated action of each alert (thresholds 0.60 and 0.15), used to derive the event log."""
    gated = gate_decision(alerts)
    return gated.select(*alerts.columns, "top_action", "action_code")


class Views:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the times of the tables carry no zone
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, make) -> DataFrame:
        """A derived table written once for this object."""
        return self.kept(name, lambda: settle(make(), name))

    def kept(self, name: str, make) -> DataFrame:
        """A table that is settled where it is made, made once for this object."""
        if name not in self._stored:
            self._stored[name] = make()
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def alerts(self) -> DataFrame:
        return alerts_from(self.table("events"))

    def train(self) -> DataFrame:
        return self.alerts().filter("is_train")

    def test(self) -> DataFrame:
        return self.alerts().filter("not is_train")

    def alerts_leaky(self) -> DataFrame:
        return self.alerts().withColumn("incident_id", F.col("user_id").cast("string"))

    def raw_alerts(self) -> DataFrame:
        """The 13 raw columns under their published names."""
        a = self.alerts()
        return a.select(
            F.col("incident_id").alias("IncidentId"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
            F.col("category").alias("Category"), F.col("mitre").alias("MitreTechniques"),
            F.col("grade").alias("IncidentGrade"), F.col("action_grouped").alias("ActionGrouped"),
            F.col("action_granular").alias("ActionGranular"), F.col("entity_type").alias("EntityType"),
            F.col("evidence_role").alias("EvidenceRole"), F.col("threat_family").alias("ThreatFamily"),
            F.col("os_family").alias("OSFamily"), F.col("suspicion").alias("SuspicionLevel"),
            F.col("verdict").alias("LastVerdict"),
        )

    def activity(self) -> DataFrame:
        """Event log of the alerts: import, inference, routing, approval."""
        return activity_from(self.alerts())

    def live_alerts(self) -> DataFrame:
        """Alerts with their current status and analyst: a projection, so each query reads the columns it needs."""
        gated = gate_columns(self.alerts())
        pending = F.col("action_code") == 2
        status = (
            F.when(F.col("event_id") % 50 == 0, "WAITING_INFERENCE")
            .when(pending & (F.col("k") % 7 == 0), "APPROVED")
            .when(pending, "HUMAN_REVIEW_PENDING")
            .when(F.col("action_code") == 1, "MODEL_BLOCKED")
            .otherwise("MODEL_ALLOWED")
        )
        names = [a[0] for a in ANALYSTS] + [None]
        return gated.withColumns({
            "status": status,
            "agent_status": F.when(F.col("event_id") % 50 == 0, "WAITING_INFERENCE").otherwise("INFERRED"),
            "requires_human_review": (F.col("event_id") % 50 != 0) & pending & (F.col("k") % 7 != 0),
            "assigned_analyst": F.when(
                (F.col("event_id") % 50 != 0) & pending, pick((F.col("event_id") + F.col("k")) % 5, names)
            ),
            "severity": F.col("suspicion"),
            "title": F.concat_ws(" / ", "category", "threat_family"),
            "cycle_id": F.concat(F.lit("C"), F.date_format("ts", "yyyyMMdd")),
        })

    def analysts(self) -> DataFrame:
        rows = ", ".join(f"('{i}', '{n}', '{r}', {c}L, {str(on).lower()})" for i, n, r, c, on in ANALYSTS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(analyst_id, name, role, capacity, active)")

    def run_history(self) -> DataFrame:
        """One run per user; the epoch is the number of the event within the user.

        Numbered without one task per user (see operators.ordered), and stored.
        """
        return self.stored("history", self._run_history)

    def _run_history(self) -> DataFrame:
        rows = self.table("events").select(
            F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("action"), "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("ts").cast("timestamp").alias("ts"),
        )
        return positioned(rows, ["run_id"], "event_id").select(
            "run_id", "event_id", (F.col("position") + 1).alias("epoch"), (F.col("value") / 1000).alias("score"),
            (F.lit(1.0) / (F.col("position") + 2)).alias("loss"), "action", (F.col("run_id") % 5).alias("seed"),
            (F.col("k") + 1).alias("updates"), "value", "k", "ts",
        )

    def requests(self) -> DataFrame:
        return requests_from(self.table("events"))

    def feedback(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select(
            "event_id",
            pick(k % 5, ["failed", "approved", "rejected", "cancelled", "executed"]).alias("outcome"),
            pick(F.col("event_id") % 3, [True, False, None]).alias("correct"),
            F.col("value").alias("seconds"),
        )

    def time_texts(self) -> DataFrame:
        """Event times as ISO text with and without 'Z', as epoch text, and malformed."""
        k = F.get_json_object("props", "$.k").cast("long")
        iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
        return self.table("events").select(
            "event_id",
            F.when(k % 4 == 0, iso).when(k % 4 == 1, F.concat(iso, F.lit("Z"))).when(k % 4 == 2, epoch)
            .otherwise(F.concat(F.lit("bad-"), k.cast("string"))).alias("stamp"),
        )

    def alerts_big(self) -> DataFrame:
        line = self.table("lineitem")
        return line.select(
            F.col("l_orderkey").alias("incident_id"), F.col("l_returnflag").alias("category"),
            ((F.col("l_linenumber") + F.col("l_suppkey")) % 4).cast("long").alias("grade_code"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("l_linestatus").alias("os_family"), F.col("l_quantity").alias("value"),
            *[
                (((F.col("l_orderkey") * m + F.col("l_suppkey")) % 100).cast("double") / 50 - 1).alias(f"q{i}")
                for i, m in enumerate((7, 13, 29))
            ],
        )


def activity_from(alerts: DataFrame) -> DataFrame:
    """One scan of the alerts, exploded to their events."""
    g = gate_columns(alerts)
    action = pick(F.col("action_code"), ["allow", "block", "human_review"])
    imported = F.unix_micros("ts")
    inferred = imported + F.col("k") * 10000
    approved = imported + F.round(F.col("value") * 1e6).cast("long")
    nothing = F.lit(None).cast("string")

    def event(seq, name, actor, micros, act=nothing):
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("action"), actor.alias("actor"),
            F.timestamp_micros(micros).alias("ts"), act.alias("decided"),
        )

    analyst = pick((F.col("event_id") + F.col("k")) % 4, [a[0] for a in ANALYSTS])
    ran = F.col("event_id") % 50 != 0
    events = F.array(
        event(0, "ALERT_IMPORTED", F.lit("system"), imported),
        F.when(ran, event(1, "AGENT_INFERENCE", F.lit("agent"), inferred, action)),
        F.when(ran & (F.col("action_code") == 2), event(2, "HUMAN_REVIEW_ROUTED", F.lit("system"), inferred)),
        F.when(F.col("k") % 7 == 0, event(3, "HUMAN_APPROVED", analyst, approved)),
    )
    return g.select(
        "alert_id", "event_id", F.concat(F.lit("C"), F.date_format("ts", "yyyyMMdd")).alias("cycle_id"),
        F.inline(events),
    ).filter("action is not null")


def requests_from(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


# seven prefixes of the request paths in matching order; two overlap
REQUEST_COMPONENTS = [
    ("clicks_one", "/api/click/1"), ("clicks", "/api/click"), ("views", "/api/view"),
    ("errors", "/api/error"), ("buys", "/api/purchase"), ("joins", "/api/signup"), ("ghost", "/api/ghost"),
]
