"""Data quality, feature screening and classification reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.constants import GRADES, OBSERVATION
from triagemill.functions.missing import absent, finite
from triagemill.operators.clean import is_leaky_name
from triagemill.session import settle


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("rows"))


def audit_split(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows.

    Equal rows are merged before the shuffle, so copies cost nothing extra.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    empty = sum((absent(df, c).cast("long") for c in df.columns), F.lit(0))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(empty * F.col("_copies")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def missing_stats(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells in one map-side aggregate."""
    empty = sum((absent(df, c).cast("long") for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(empty), F.lit(0)).alias("missing"),
    )


def pipeline_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per split and total; the total number of columns is that of train."""
    parts = missing_stats(train).select(F.lit("train").alias("split"), "*").unionByName(
        missing_stats(test).select(F.lit("test").alias("split"), "*"))
    total = parts.agg(
        F.lit("total").alias("split"), F.sum("rows").alias("rows"),
        F.max(F.when(F.col("split") == "train", F.col("columns"))).alias("columns"), F.sum("missing").alias("missing"))
    return parts.unionByName(total)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent per class, nulls kept; the window is over the classes only."""
    counts = class_counts(df, target)
    return counts.withColumn("percent", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()))


def value_counts(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """(column, value[, target]) counts of all columns in one pass, null as a value."""
    keep = [] if target is None else [F.col(target).cast("string").alias("_target")]
    wide = df.select(*keep, *[F.when(~absent(df, c), F.col(c).cast("string")).alias(c) for c in columns])
    names = [] if target is None else ["_target"]
    if target is not None and target in columns:
        raise ValueError("the target cannot screen itself")
    long = wide.unpivot(names, list(columns), "column", "value")
    return long.groupBy("column", "value", *names).agg(F.count(F.lit(1)).alias("n"))


def feature_health(df: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, distinct (null counts), missing, moments, forbidden flags."""
    columns = list(df.columns)
    spread = value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("n").alias("_rows"),
    )
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    out = spread
    if numeric:
        parts = []
        for c in numeric:
            x = finite(F.col(c).cast("double"))
            parts.append(F.struct(
                F.lit(c).alias("column"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max")))
        moments = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
        out = out.join(moments, "column", "left")
    else:
        out = out.withColumns({n: F.lit(None).cast("double") for n in ("mean", "std", "min", "max")})
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    return out.select(
        F.col("column"), F.element_at(kinds, F.col("column")).alias("dtype"), "unique", "missing",
        (F.col("missing") * 100.0 / F.col("_rows")).alias("missing_pct"), "mean", "std", "min", "max",
        F.col("column").isin(list(forbidden)).alias("forbidden_role"),
        is_leaky_name(F.col("column")).alias("forbidden_name"),
    )


def _plogp(p: Column) -> Column:
    return -p * F.log2(p + F.lit(1e-12))


def information_gain(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Entropy of the target minus its entropy given each column, in one pass."""
    joint = value_counts(df, columns, target)
    per_value = joint.groupBy("column", "value").agg(
        F.sum("n").alias("nv"),
        F.collect_list("n").alias("by_class"),  # at most one entry per class
    )
    given = F.aggregate(
        F.transform("by_class", lambda n: _plogp(n / F.col("nv"))), F.lit(0.0), lambda s, x: s + x)
    conditional = per_value.groupBy("column").agg(
        (F.sum(F.col("nv") * given) / F.sum("nv")).alias("_given"), F.count(F.lit(1)).alias("unique"))
    classes = df.groupBy(F.col(target).cast("string").alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    shares = classes.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    whole = shares.agg(F.sum(_plogp(F.col("p"))).alias("h"))
    return conditional.select("column", (whole.scalar() - F.col("_given")).alias("information_gain"), "unique")


def select_features(
    df: DataFrame, target: str, identifier: str, k: int = 8,
    base: Sequence[str] = OBSERVATION, max_distinct_ratio: float | None = None,
) -> DataFrame:
    """The base columns, then at most ``k`` safe further columns by information gain."""
    health = feature_health(df, [target, identifier])
    screened = [c for c in df.columns if c not in (target, identifier)]
    gain = information_gain(df, screened, target).select("column", "information_gain")
    joined = settle(health.join(gain, "column"), "screen")  # one row per column
    safe = joined.filter(
        ~F.col("forbidden_role") & ~F.col("forbidden_name") & (F.col("missing_pct") <= 50) & (F.col("unique") > 1))
    if max_distinct_ratio is not None:
        rows = df.agg(F.count(F.lit(1))).scalar()
        safe = safe.filter(F.col("unique") <= rows * max_distinct_ratio)
    extra = safe.filter(~F.col("column").isin(list(base)))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("information_gain"), "column"))  # over columns
    added = extra.withColumn("position", rank).filter(F.col("position") <= k).select(
        "column", (F.col("position") + len(base)).cast("long").alias("position"), F.lit(False).alias("is_base"))
    where = F.array_position(F.array(*[F.lit(c) for c in base]), F.col("column"))
    kept = joined.filter(F.col("column").isin(list(base))).select(
        "column", where.cast("long").alias("position"), F.lit(True).alias("is_base"))
    return kept.unionByName(added)


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts per (label, prediction); zero cells included."""
    n = len(GRADES)
    counts = df.groupBy(F.col(label).cast("long").alias("label")).agg(
        *[F.count_if(F.col(predicted) == i).alias(f"pred_{i}") for i in range(n)])
    grid = df.sparkSession.range(n).withColumnRenamed("id", "label")
    return grid.join(counts, "label", "left").na.fill(0)


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per grade (0 where undefined)."""
    n = len(GRADES)
    agg = []
    for i in range(n):
        is_l, is_p = F.col(label) == i, F.col(predicted) == i
        agg.append(F.struct(
            F.lit(i).cast("long").alias("label"), F.count_if(is_l & is_p).alias("tp"),
            F.count_if(is_p).alias("predicted"), F.count_if(is_l).alias("support")))
    rows = df.agg(F.array(*agg).alias("a")).select(F.inline("a"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    rows = rows.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Overall scores in one row; classes without rows are not averaged into balanced accuracy."""
    per = class_report(df, label, predicted)
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    support = F.sum("support")
    return per.agg(
        (F.sum("tp") / support).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / support).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / support).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / support).alias("weighted_f1"),
        F.max(F.when(F.col("label") == 2, F.col("recall"))).alias("true_positive_recall"),
        F.max(F.when(F.col("label") == 3, F.col("f1"))).alias("unknown_f1"),
        support.alias("support"),
    )


def binary_confusion(df: DataFrame, predicted: str, label: str) -> DataFrame:
    same, one = F.col(predicted) == F.col(label), F.col(predicted) == 1
    return df.agg(
        F.count_if(same & one).alias("tp"), F.count_if(same & ~one).alias("tn"),
        F.count_if(~same & one).alias("fp"), F.count_if(~same & ~one).alias("fn"))


def quality_gate(current: DataFrame, expanded: DataFrame, overlap: Column | int) -> DataFrame:
    """Four rules on two classification reports; all must hold."""
    both = current.select(F.struct("*").alias("cur")).withColumn("exp", expanded.select(F.struct("*")).scalar())
    shared = F.lit(overlap) if isinstance(overlap, int) else overlap
    cur, exp = F.col("cur"), F.col("exp")
    out = both.select(
        (exp["macro_f1"] - cur["macro_f1"]).alias("macro_f1_change"),
        (exp["true_positive_recall"] - cur["true_positive_recall"]).alias("tp_recall_change"),
        (exp["unknown_f1"] - cur["unknown_f1"]).alias("unknown_f1_change"),
        (shared == 0).alias("zero_overlap"),
        (exp["macro_f1"] >= cur["macro_f1"] + 0.03).alias("macro_f1_ok"),
        (exp["true_positive_recall"] >= cur["true_positive_recall"] + 0.10).alias("tp_recall_ok"),
        (exp["unknown_f1"] >= F.greatest(F.lit(0.05), cur["unknown_f1"] - 0.02)).alias("unknown_ok"),
    )
    return out.withColumn("passed", F.expr("zero_overlap and macro_f1_ok and tp_recall_ok and unknown_ok"))
