"""Enrichment of alerts and events from other tables.

No broadcast is forced on data of unknown size: Spark picks the join from the
measured size of the sides, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last duplicate of each key, merged map-side."""
    names = [c for c in df.columns if c not in (key, ordinal)]
    row = F.max_by(F.struct(*names), F.col(ordinal)).alias("_r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])


def attach_lineage(source: DataFrame, processed: DataFrame, mapping: DataFrame, key: str = "alert_id", ordinal: str = "ordinal") -> DataFrame:
    """Source with its processed row and its mapping row as structs, null when absent."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        last = last_per_key(df, key, ordinal)
        return last.select(key, F.struct(*[c for c in last.columns if c != key]).alias(name))

    return source.join(packed(processed, "processed"), key, "left").join(packed(mapping, "lineage"), key, "left")


def enrich_decisions(events: DataFrame, alerts: DataFrame, fields: Sequence[str], key: str = "alert_id") -> DataFrame:
    """Fields of the event first, then those of its alert."""
    known = [f for f in fields if f in events.columns]
    right = alerts.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    joined = events.join(right, key, "left")
    merged = {f: F.coalesce(F.col(f), F.col(f"_a_{f}")) if f in known else F.col(f"_a_{f}") for f in fields}
    return joined.withColumns(merged).drop(*[f"_a_{f}" for f in fields])


def prefix_component(path: Column, components: Sequence[tuple[str, str]]) -> Column:
    """First component whose prefix starts the path; null when none does."""
    return F.coalesce(*[F.when(path.startswith(prefix), name) for name, prefix in components])


def route_by_prefix(requests: DataFrame, components: Sequence[tuple[str, str]], path: str = "path") -> DataFrame:
    return requests.withColumn("component", prefix_component(F.col(path), components))


def union_runs(current: DataFrame, archived: DataFrame, legacy: DataFrame, path: str = "path") -> DataFrame:
    """All runs; a legacy run is dropped when its path is already listed."""
    listed = current.unionByName(archived, allowMissingColumns=True)
    fresh = legacy.join(listed.select(path).distinct(), path, "left_anti")
    return listed.unionByName(fresh, allowMissingColumns=True)


def overlay_epoch_actions(history: DataFrame, raw: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Replace the action counts of an epoch by the first non-empty raw distribution."""
    filled = [F.when(F.size(F.col(f)) > 0, F.col(f)) for f in fields]
    right = raw.select(*keys, F.coalesce(*filled).alias("_d"))
    return history.join(right, list(keys), "left").withColumn(
        "action_distribution", F.coalesce("_d", "action_distribution")).drop("_d")


def refresh_source(
    alerts: DataFrame, source: DataFrame, column: str = "source", key: str = "alert_id", ordinal: str | None = None,
) -> DataFrame:
    """Replace the source record of alerts that exist; ``changed`` marks real changes.

    Of several records of a key the last one counts, by ``ordinal`` or by place in the input.
    """
    place = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    right = last_per_key(source.select(key, F.col(column).alias("_new"), place.alias("_place")), key, "_place")
    joined = alerts.join(right, key, "left")
    fresh = F.coalesce("_new", column)
    return joined.withColumn("changed", ~F.col(column).eqNullSafe(fresh)).withColumn(column, fresh).drop("_new")


def check_alignment(raw: DataFrame, processed: DataFrame, key: str, time: str) -> DataFrame:
    """Rows on one side only and rows whose times differ, by key."""
    left = raw.select(F.col(key), F.col(time).alias("_l"), F.lit(True).alias("_inl"))
    right = processed.select(F.col(key), F.col(time).alias("_r"), F.lit(True).alias("_inr"))
    both = left.join(right, key, "full")
    return both.agg(
        F.count_if(F.col("_inl").isNotNull()).alias("left_rows"), F.count_if(F.col("_inr").isNotNull()).alias("right_rows"),
        F.count_if(F.col("_inl").isNull() | F.col("_inr").isNull()).alias("unmatched"),
        F.count_if(F.col("_inl") & F.col("_inr") & ~F.col("_l").eqNullSafe(F.col("_r"))).alias("time_differs"))
