"""Incident-disjoint splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.functions.scoring import hash_uniform
from triagemill.operators.ordered import positioned


def distinct_ids(df: DataFrame, incident: str = "incident_id") -> DataFrame:
    return df.select(F.col(incident).cast("string").alias("incident_id")).dropna().distinct()


def id_membership(parts: dict[str, DataFrame], incident: str = "incident_id") -> DataFrame:
    """(id, one flag per part): all parts in a single aggregate."""
    stacked = None
    for name, df in parts.items():
        one = df.select(F.col(incident).cast("string").alias("incident_id"), F.lit(name).alias("_part"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.dropna(subset=["incident_id"]).groupBy("incident_id").agg(
        *[F.bool_or(F.col("_part") == name).alias(name) for name in parts])


def split_overlap(parts: dict[str, DataFrame], incident: str = "incident_id") -> DataFrame:
    """Shared ids of every pair of parts, as (left, right, shared)."""
    names = list(parts)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    counts = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.count_if(F.col(a) & F.col(b)).alias("shared"))
        for a, b in pairs]
    return id_membership(parts, incident).agg(F.array(*counts).alias("a")).select(F.inline("a"))


def require_disjoint(overlap: DataFrame) -> None:
    """Fail when any pair shares an id (one row per pair is read)."""
    bad = overlap.filter("shared > 0").collect()
    if bad:
        raise ValueError("shared incidents: " + ", ".join(f"{r['left']}/{r['right']}={r['shared']}" for r in bad))


def clamp_ratio(ratio: float) -> float:
    return min(max(ratio, 0.50), 0.95)


def incident_split(df: DataFrame, ratio: float = 0.80, seed: int = 4242, incident: str = "incident_id") -> DataFrame:
    """Add ``split``: train or validation by the hash of the incident.

    No shuffle and no id list: all alerts of an incident hash alike, whatever
    the number of partitions. The ratio holds in expectation.
    """
    share = hash_uniform(F.lit(seed), F.col(incident))
    return df.withColumn("split", F.when(share < clamp_ratio(ratio), "train").otherwise("validation"))


def incident_split_exact(df: DataFrame, ratio: float = 0.80, seed: int = 4242, incident: str = "incident_id") -> DataFrame:
    """(id, split) with exactly int(n * ratio) train incidents, ranked by their hash."""
    ids = distinct_ids(df, incident).withColumn("_h", hash_uniform(F.lit(seed), F.col("incident_id")))
    ids = ids.withColumn("_t", F.xxhash64("incident_id"))
    ranked = positioned(ids, [], "_h", "_t")
    train = F.col("position") < F.floor(F.col("group_size") * clamp_ratio(ratio))
    return ranked.select("incident_id", F.when(train, "train").otherwise("validation").alias("split"))


def partition_rows(df: DataFrame, ids: DataFrame, incident: str = "incident_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose incident is in ``ids``, and the other rows."""
    keys = ids.select(F.col("incident_id").alias(incident)).distinct()
    return df.join(keys, incident, "left_semi"), df.join(keys, incident, "left_anti")


def split_report(df: DataFrame, split: str = "split", incident: str = "incident_id") -> DataFrame:
    """Rows, share of all rows and incidents per split, and incidents that sit in several splits.

    The incidents that two given splits share are counted by :func:`split_overlap`.
    """
    per = df.groupBy(incident, split).agg(F.count(F.lit(1)).alias("_n"))
    own = per.groupBy(split).agg(F.sum("_n").alias("rows"), F.count(incident).alias("incidents"))
    shared = per.groupBy(incident).agg(F.count(F.lit(1)).alias("_s")).agg(F.count_if(F.col("_s") > 1))
    total = per.agg(F.sum("_n"))
    return own.withColumns({"share": F.col("rows") / total.scalar(), "shared_incidents": shared.scalar()})
