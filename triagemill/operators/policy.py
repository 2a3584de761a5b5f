"""Action-value policies: lookup tables, regressors, and a given network."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS
from triagemill.functions.rewards import action_name, rewards_of
from triagemill.functions.scoring import first_of_three
from triagemill.operators.forest import fit_forest, predict_forest
from triagemill.operators.quality import classification_report, quality_gate
from triagemill.session import settle, sized_join


def _filled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_k_{k}": F.coalesce(F.col(k).cast("string"), F.lit("Unknown")) for k in keys})


def fit_action_values(train: DataFrame, keys: Sequence[str], min_n: int = 1, grade: str = "grade_code") -> DataFrame:
    """Mean reward of each action per state cell, with every coarser level.

    With all rewards of an alert known and one-step episodes, this mean is the
    value the learners aim at. Level 0 is the global mean; level i uses the
    first i keys; cells with fewer than ``min_n`` rows are left to a coarser level.
    """
    rewards = rewards_of(F.col(grade))
    rows = _filled(train, keys).withColumns({f"_r{i}": rewards[i] for i in range(len(ACTIONS))})
    names = [f"_k_{k}" for k in keys]
    cells = rows.groupBy(*names).agg(
        *[F.sum(f"_r{i}").alias(f"_s{i}") for i in range(len(ACTIONS))], F.count(F.lit(1)).alias("_n"))
    # the coarser levels are rolled up from the cells; the training rows are not multiplied
    t = cells.rollup(*names).agg(
        *[(F.sum(f"_s{i}") / F.sum("_n")).alias(f"q{i}") for i in range(len(ACTIONS))], F.sum("_n").alias("n"),
        F.grouping_id().alias("_g"))
    level = F.lit(len(keys)) - F.bit_count("_g")
    table = t.withColumn("level", level.cast("long")).filter((F.col("level") == 0) | (F.col("n") >= min_n))
    return settle(table.select("level", *[F.col(n).alias(k) for n, k in zip(names, keys)], "q0", "q1", "q2", "n"), "policy")


def score_lookup(df: DataFrame, policy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """q0, q1, q2 from the finest level of the policy that has the cell."""
    out = _filled(df.drop("q0", "q1", "q2"), keys)
    found = []
    for level in range(len(keys), 0, -1):
        part = policy.filter(F.col("level") == level).select(
            *[F.col(k).alias(f"_k_{k}") for k in keys[:level]], F.struct("q0", "q1", "q2").alias(f"_q{level}"))
        out = sized_join(out, part, [f"_k_{k}" for k in keys[:level]])
        found.append(F.col(f"_q{level}"))
    whole = policy.filter("level = 0").select(F.struct("q0", "q1", "q2")).scalar()
    out = out.withColumn("_q", F.coalesce(*found, whole))
    out = out.withColumns({f"q{i}": F.col("_q")[f"q{i}"] for i in range(len(ACTIONS))})
    return out.drop("_q", *[f"_k_{k}" for k in keys], *[f"_q{i + 1}" for i in range(len(keys))])


def score_actions(scored: DataFrame) -> DataFrame:
    """Evaluation form: first maximum, its name, and the value columns."""
    best = first_of_three(F.col("q0"), F.col("q1"), F.col("q2"))
    return scored.withColumns({
        "action": best, "action_name": action_name(best), "q_allow": F.col("q0"), "q_block": F.col("q1"),
        "q_human_review": F.col("q2")})


def score_network(df: DataFrame, layers: Sequence[tuple], state: str = "state") -> DataFrame:
    """q0, q1, q2 of a feed-forward network given as (weights, bias) arrays.

    The arrays (a few hundred kilobytes) travel with the task; states go
    through Arrow in batches and are multiplied as one matrix.
    """
    held = df.sparkSession.sparkContext.broadcast([(np.asarray(w, "float32"), np.asarray(b, "float32")) for w, b in layers])

    @F.pandas_udf("q0 double, q1 double, q2 double")
    def values(states: pd.Series) -> pd.DataFrame:
        x = np.stack(states.to_numpy()).astype("float32") if len(states) else np.zeros((0, len(held.value[0][0])), "float32")
        for i, (w, b) in enumerate(held.value):
            x = x @ w + b
            if i < len(held.value) - 1:
                x = np.maximum(x, 0)
        return pd.DataFrame(x.astype("float64"), columns=["q0", "q1", "q2"])

    out = df.drop("q0", "q1", "q2").withColumn("_q", values(F.col(state)))
    return out.withColumns({f"q{i}": F.col("_q")[f"q{i}"] for i in range(3)}).drop("_q")


def fit_action_values_ml(train: DataFrame, features: Sequence[str], grade: str = "grade_code", trees: int = 0):
    """One regressor per action on the feature columns; boosted trees when asked for."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rewards = rewards_of(F.col(grade))
    rows = train.select(*features, *[rewards[i].alias(f"_r{i}") for i in range(len(ACTIONS))])
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")]
    for i in range(len(ACTIONS)):
        names = dict(featuresCol="_x", labelCol=f"_r{i}", predictionCol=f"q{i}")
        stages.append(GBTRegressor(maxIter=trees, seed=42, **names) if trees else LinearRegression(**names))
    # every regressor reads the rows again: they are computed and written once
    return Pipeline(stages=stages).fit(settle(rows, "fitted"))


def score_ml(df: DataFrame, model) -> DataFrame:
    return model.transform(df.drop("q0", "q1", "q2")).drop("_x")


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = settle(train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "classes")
    totals = counts.agg(F.struct(F.sum("_n").alias("all"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = counts.withColumn("_t", totals).select(
        label, (F.col("_t.all") / (F.col("_t.k") * F.col("_n"))).alias("weight"))
    return sized_join(train, weights, [label])


def grade_baseline(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "grade_code",
    trees: int = 200, depth: int = 20, leaf: int = 5, seed: int = 42,
) -> DataFrame:
    """Balanced random forest on the feature columns; the test rows with ``prediction``."""
    rows = class_weights(settle(train.select(*features, label), "train"), label)
    return predict_forest(test, fit_forest(rows, features, label, "weight", trees, depth, leaf, seed))


def compare_baselines(
    train: DataFrame, test: DataFrame, current: Sequence[str], expanded: Sequence[str], label: str = "grade_code",
    overlap: Column | int = 0, **forest,
) -> dict[str, DataFrame]:
    """Two feature sets under one experiment: same rows, same classes and weights, same forest, same seed.

    Gives the written ``current`` and ``expanded`` predictions, ``scores`` with a row per feature set and metric of the
    class report, and the ``gate`` that says whether the expanded set may replace the current one.
    """
    made = {}
    for name, features in (("current", current), ("expanded", expanded)):
        made[name] = settle(grade_baseline(train, test, features, label, **forest).select(F.col(label), "prediction"), name)
    reports = {name: settle(classification_report(p, label, "prediction"), "report") for name, p in made.items()}
    scores = None
    for name, report in reports.items():
        doubles = report.select(*[F.col(c).cast("double").alias(c) for c in report.columns])
        rows = doubles.unpivot([], report.columns, "metric", "value").select(F.lit(name).alias("feature_set"), "metric", "value")
        scores = rows if scores is None else scores.unionByName(rows)
    return made | {"scores": scores, "gate": quality_gate(reports["current"], reports["expanded"], overlap)}


def fingerprint(table: DataFrame) -> DataFrame:
    """Order-free content hash of a table in one map-side aggregate."""
    # every value is preceded by its length, null by nothing, so that different rows give different texts
    texts = [F.col(c).cast("string") for c in sorted(table.columns)]
    text = F.concat(*[F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("~")) for x in texts])
    names = ",".join(f"{len(c)}:{c}" for c in sorted(table.columns))
    digest = F.md5(text.cast("binary"))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")

    sums = table.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part(1).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"),
        F.coalesce(F.bit_xor(part(9)), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(part(17)), F.lit(0)).alias("y"))
    return sums.select(F.sha2(F.concat_ws(":", "n", "s", "x", "y", F.lit(names)).cast("binary"), 256).alias("fingerprint"), F.col("n").alias("rows"))


def table_version(table: DataFrame, registry: DataFrame, name: str, stamp: Column) -> DataFrame:
    """The registered version of an unchanged table, else name-stamp-hash."""
    own = fingerprint(table)
    known = registry.filter(F.col("name") == name).select("fingerprint", F.col("version").alias("_old"))
    fresh = F.concat_ws("-", F.lit(name), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"), F.substring("fingerprint", 1, 10))
    return own.join(known, "fingerprint", "left").select(
        F.lit(name).alias("name"), "fingerprint", "rows", F.coalesce("_old", fresh).alias("version"),
        F.col("_old").isNotNull().alias("unchanged"))


def incompatible_entries(registry: DataFrame, expected: dict) -> DataFrame:
    """Registry entries that differ in algorithm, schema version or dimensions, with the fields."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in expected.items()]))
    return registry.withColumn("differs", F.concat_ws(",", wrong)).filter("differs <> ''")
