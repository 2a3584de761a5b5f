"""Cleaning, projections, predicates and text rules on alert tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import ACTION_ALIASES, LEAKY_PATTERNS, OBSERVATION, REVIEW_WORDS, TIME_ALIASES


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill("Unknown", subset=list(columns))


def canonical_columns(df: DataFrame, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rename the first existing alias of each canonical name."""
    for target, names in (aliases or {"ts": TIME_ALIASES, "logged_action": ACTION_ALIASES}).items():
        found = [n for n in names if n in df.columns]
        if found and target not in df.columns:
            df = df.withColumnRenamed(found[0], target)
    return df


def require_logged_action(df: DataFrame) -> DataFrame:
    """Behaviour-based use needs an action that was really logged."""
    if "logged_action" not in df.columns:
        raise ValueError("no logged action column; refuse to invent behaviour")
    return df


def observation_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Only what is known before the decision."""
    return df.select(*keep, *[c for c in OBSERVATION if c in df.columns])


def is_leaky_name(name: Column) -> Column:
    plain = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    return F.greatest(*[plain.contains(p).cast("int") for p in LEAKY_PATTERNS]) == 1


def leaky_columns(df: DataFrame, target: str, identifier: str) -> DataFrame:
    """Per column: filled cells, and whether its name or its role forbids it."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "column", "filled")
    return long.select(
        "column", "filled",
        is_leaky_name(F.col("column")).alias("by_name"),
        F.col("column").isin(target, identifier).alias("by_rule"),
    )


def alert_headline(df: DataFrame) -> DataFrame:
    """Title 'category / family' and severity, with their defaults."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Security alert"))
    family = F.coalesce(F.nullif(F.col("threat_family"), F.lit("")), F.lit("Unknown"))
    level = F.col("suspicion")
    vague = level.isNull() | level.isin("", "Unknown")
    return df.withColumns({
        "title": F.concat_ws(" / ", category, family),
        "severity": F.when(vague, "medium").otherwise(level),
    })


def valid_alert_id(df: DataFrame, column: str = "alert_id") -> DataFrame:
    text = F.trim(F.col(column))
    return df.filter((text != "") & (F.lower(text) != "none"))


def search_alerts(df: DataFrame, search: str | None = None, severity: str | None = None) -> DataFrame:
    """Case-insensitive pattern in any of six fields, and an exact severity."""
    if severity and severity.lower() != "all":
        df = df.filter(F.col("severity").rlike(f"(?i)^{severity}$"))
    if search:
        fields = ["alert_id", "incident_id", "title", "category", "mitre", "verdict"]
        hit = F.lit(False)
        for name in fields:
            hit = hit | F.coalesce(F.col(name).rlike(f"(?i){search}"), F.lit(False))
        df = df.filter(hit)
    return df


def decision_text_filter(df: DataFrame, text: str) -> DataFrame:
    wanted = text.lower().strip()
    if not wanted:
        return df
    fields = ["decision_id", "alert_id", "incident_id", "action", "algorithm", "verdict"]
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields])
    return df.filter(F.lower(joined).contains(wanted))


def review_priority(df: DataFrame, grade: str = "grade", suspicion: str = "suspicion") -> DataFrame:
    """Rank 0 (high) to 3 (context only); the first rule that holds wins."""
    g, s = F.lower(F.coalesce(F.col(grade), F.lit(""))), F.lower(F.coalesce(F.col(suspicion), F.lit("")))
    rank = (
        F.when(g.contains("truepositive") | s.contains("critical") | s.contains("high"), 0)
        .when(g.contains("falsepositive") | s.contains("medium") | s.contains("suspicious"), 1)
        .when(g.contains("benignpositive") | s.contains("low"), 2)
        .otherwise(3)
    )
    names = F.array(*[F.lit(n) for n in ("HIGH", "MEDIUM", "LOW", "REVIEW")])
    return df.withColumn("priority_rank", rank.cast("long")).withColumn(
        "priority", F.get(names, F.col("priority_rank").cast("int"))
    )


def review_status(word: Column) -> Column:
    """Status of an accepted review word, null for any other."""
    pairs = [F.lit(x) for pair in REVIEW_WORDS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(word)))


def normalise_review(reviews: DataFrame, column: str = "decision") -> tuple[DataFrame, DataFrame]:
    """Accepted reviews with their status, and the rejected ones."""
    marked = reviews.withColumn("status", review_status(F.col(column)))
    return marked.filter(F.col("status").isNotNull()), marked.filter(F.col("status").isNull()).drop("status")


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or occur more than once (empty when all is well)."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) | F.col(key).isNull())
    )


def expect_count(stages: dict[str, DataFrame], expected: int | Column | None = None) -> DataFrame:
    """Rows per stage against the expected number (default: the first stage)."""
    out = None
    for order, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit(order).cast("long").alias("step"), F.lit(name).alias("stage"), "actual"
        )
        out = one if out is None else out.unionByName(one)
    if expected is None:
        first = next(iter(stages.values())).agg(F.count(F.lit(1)).alias("n"))
        wanted = first.scalar()
    else:
        wanted = F.lit(expected)
    return out.withColumn("expected", wanted.cast("long")).withColumn("matches", F.col("actual") == F.col("expected"))


def require_counts(report: DataFrame) -> None:
    """Fail when a stage lost or gained rows."""
    wrong = report.filter(~F.col("matches")).limit(20).collect()
    if wrong:
        raise ValueError("row counts differ: " + ", ".join(f"{r.stage}={r.actual}/{r.expected}" for r in wrong))


def round_scores(df: DataFrame, confidence: str, observation: str) -> DataFrame:
    return df.withColumns({
        confidence: F.round(confidence, 6),
        observation: F.transform(observation, lambda x: F.round(x, 8)),
    })


def humanize(text: Column) -> Column:
    """Underscores and hyphens to spaces, first letter of each word in upper case."""
    spaced = F.regexp_replace(text, "[_-]", " ")
    words = F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")
