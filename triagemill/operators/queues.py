"""Pages, queues and newest-first feeds.

Ordered pages are ``orderBy().offset().limit()``: every task keeps only the
rows of the page and those before it, and no full sort is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagemill.constants import OPEN_STATUSES
from triagemill.operators.clean import review_priority, search_alerts


def newest_first(df: DataFrame, time: str = "ts", tie: str = "event_id") -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_last(), F.desc(tie))


def page_alerts(
    alerts: DataFrame, search: str | None = None, severity: str | None = None, skip: int = 0, limit: int = 100,
) -> DataFrame:
    """One page of the matching alerts, each row with the total before paging."""
    if skip < 0 or not 1 <= limit <= 500:
        raise ValueError("skip must be >= 0 and limit within 1..500")
    found = search_alerts(alerts, search, severity)
    total = found.agg(F.count(F.lit(1)))
    return newest_first(found).offset(skip).limit(limit).withColumn("total", total.scalar())


def matching_total(alerts: DataFrame, search: str | None = None, severity: str | None = None) -> DataFrame:
    """The total of a search in one row, also for a page that lies past the end."""
    return search_alerts(alerts, search, severity).agg(F.count(F.lit(1)).alias("total"))


def page_after(
    alerts: DataFrame, last: tuple | None, search: str | None = None, severity: str | None = None, limit: int = 100,
    time: str = "ts", tie: str = "event_id",
) -> DataFrame:
    """The page that follows the row with (time, tie) = ``last``; the first page for None.

    However deep the page, a task keeps no more rows than the page has. Rows without a time come last.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    found = search_alerts(alerts, search, severity)
    if last is not None:
        at, number = last
        earlier = F.col(tie) < F.lit(number)
        if at is None:
            found = found.filter(F.col(time).isNull() & earlier)
        else:
            found = found.filter(F.col(time).isNull() | (F.col(time) < F.lit(at)) | ((F.col(time) == F.lit(at)) & earlier))
    return newest_first(found, time, tie).limit(limit)


def review_queue(alerts: DataFrame, n: int = 100, filter_first: bool = False) -> DataFrame:
    """Alerts that need a human among the newest ``n``.

    The filter comes after the limit; ``filter_first`` asks for the newest
    ``n`` of those that need a human.
    """
    if filter_first:
        return newest_first(alerts.filter("requires_human_review")).limit(n)
    return newest_first(alerts).limit(n).filter("requires_human_review")


def pending_for_analyst(alerts: DataFrame, analyst: str | None = None, n: int = 100, filter_first: bool = False) -> DataFrame:
    wanted = F.col("status").isin(OPEN_STATUSES)
    if analyst is not None:
        wanted = wanted & (F.col("assigned_analyst") == analyst)
    if filter_first:
        return newest_first(alerts.filter(F.col("requires_human_review") & wanted)).limit(n)
    return review_queue(alerts, n).filter(wanted)


def prioritised_queue(alerts: DataFrame, page: int, size: int) -> DataFrame:
    """Page by priority rank, newest first; with page count, first and last number."""
    total = alerts.agg(F.count(F.lit(1)))
    ranked = review_priority(alerts).orderBy("priority_rank", F.col("ts").desc_nulls_last(), F.desc("event_id"))
    shown = ranked.offset((page - 1) * size).limit(size).withColumn("_n", total.scalar())
    return shown.withColumns({
        "total_pages": F.greatest(F.ceil(F.col("_n") / size), F.lit(1)),
        "page_start": F.when(F.col("_n") > 0, (page - 1) * size + 1).otherwise(0).cast("long"),
        "page_end": F.least(F.lit(page * size).cast("long"), F.col("_n"))}).drop("_n")


def alert_history(events: DataFrame, k: int = 200) -> DataFrame:
    """The newest ``k`` events of every alert; a hot alert is cut per task first."""
    newest = Window.partitionBy("alert_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= k).drop("_rn")


def activity_feed(events: DataFrame, n: int = 200) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id"), F.desc("seq")).limit(n)


def analyst_actions(events: DataFrame, actor: str | None = None, n: int = 100, filter_first: bool = False) -> DataFrame:
    """Newest ``n`` events of people (or of one actor), then only reviews and assignments."""
    people = events.filter(F.col("actor") == actor if actor else F.col("actor") != "system")
    wanted = F.col("action").startswith("HUMAN_") | F.col("action").startswith("ASSIGNED")
    if filter_first:
        return activity_feed(people.filter(wanted), n)
    return activity_feed(people, n).filter(wanted)


def latest_cycle(events: DataFrame) -> DataFrame:
    """The cycle of the newest inference event, in one row."""
    inferred = events.filter(F.col("action") == "AGENT_INFERENCE")
    return inferred.agg(F.max_by("cycle_id", F.struct("ts", "event_id")).alias("cycle_id"))


def latest_cycle_decisions(events: DataFrame, alerts: DataFrame, limit: int = 100) -> DataFrame:
    """Decisions of the latest cycle, newest first, enriched from their alerts."""
    cycle = latest_cycle(events).scalar()
    mine = events.filter((F.col("action") == "AGENT_INFERENCE") & (F.col("cycle_id") == cycle))
    top = activity_feed(mine, limit).withColumn("decision_id", F.concat_ws(":", "cycle_id", "alert_id"))
    about = alerts.select("alert_id", "incident_id", "status", "assigned_analyst", "category", "verdict")
    return top.join(about, "alert_id", "left")


def cycle_history(cycles: DataFrame, n: int = 20) -> DataFrame:
    return cycles.orderBy(F.desc("archived_at"), F.desc("cycle_id")).limit(n)
