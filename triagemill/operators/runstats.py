"""Statistics over training histories and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.functions.missing import finite
from triagemill.operators.ordered import positioned, ranked_values
from triagemill.session import settle

HASH_MASK = (1 << 31) - 1


def last_n(history: DataFrame, n: int, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """The last ``n`` points of each run; a hot run is cut per task before the shuffle."""
    newest = Window.partitionBy(run).orderBy(F.desc(epoch))
    return history.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def last_n_range(history: DataFrame, n: int, value: str, run: str = "run_id") -> DataFrame:
    points = last_n(history, n, run)
    return points.groupBy(run).agg(
        F.count(F.lit(1)).alias("points"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def _first_records(history: DataFrame, score: str, run: str, epoch: str) -> DataFrame:
    """Scored epochs with their 1-based number and the best score before them."""
    scored = history.filter(F.col(score).isNotNull() & ~F.isnan(score))
    return positioned(scored, [run], epoch, maxima={"_best_before": score}).withColumn("_at", F.col("position") + 1)


POINT = "struct<at:bigint,epoch:bigint,score:double>"
FOLD_LIMIT = 100_000  # records folded in one row; a longer run is folded piece by piece


def _fold(records: DataFrame, min_delta: float, run: str, carried: DataFrame | None = None) -> DataFrame:
    """Accepted points among at most FOLD_LIMIT records per run, after a carried best score."""
    kept = records.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("at", "epoch", "score"))).alias("_records"))
    kept = kept.withColumn("_best", F.lit(None).cast("double")) if carried is None else kept.join(carried, run, "left")

    def step(taken: Column, x: Column) -> Column:
        best = F.try_element_at(taken, F.lit(-1))["score"]
        better = best.isNull() | (x["score"] > best + min_delta)
        return F.when(better, F.concat(taken, F.array(x))).otherwise(taken)

    before = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("epoch"), F.col("_best").alias("score"))
    start = F.when(F.col("_best").isNull(), F.array().cast(f"array<{POINT}>")).otherwise(F.array(before))
    points = F.aggregate(F.col("_records").cast(f"array<{POINT}>"), start.cast(f"array<{POINT}>"), step)
    return kept.select(run, F.inline(F.filter(points, lambda p: p["at"] > 0)))


def accepted_points(numbered: DataFrame, min_delta: float, score: str, run: str, epoch: str) -> DataFrame:
    """(run, at, epoch, score) of the epochs that became best under score > best + min_delta.

    Only a score above everything before it can do so; the epochs are thinned
    to those records in parallel and the rule is folded over the records. A
    run with very many records is folded in pieces that hand on their best.
    """
    is_record = F.col("_best_before").isNull() | (F.col(score) > F.col("_best_before"))
    records = settle(numbered.filter(is_record).select(
        run, F.col("_at").alias("at"), F.col(epoch).cast("long").alias("epoch"), F.col(score).cast("double").alias("score")), "records")
    longest = records.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= FOLD_LIMIT:
        return _fold(records, min_delta, run)
    pieces = settle(
        positioned(records, [run], "at").withColumn("_piece", F.floor(F.col("position") / FOLD_LIMIT)), "pieces")
    out, carried = None, None
    for i in range((longest - 1) // FOLD_LIMIT + 1):
        part = settle(_fold(pieces.filter(F.col("_piece") == i), min_delta, run, carried), "accepted")
        last = part.groupBy(run).agg(F.max_by("score", "at").alias("_best"))
        carried = last if carried is None else (
            carried.join(last.withColumnRenamed("_best", "_new"), run, "full").select(run, F.coalesce("_new", "_best").alias("_best")))
        carried = settle(carried, "carried")
        out = part if out is None else out.unionByName(part)
    return out


REASONS = ("persistent_validation_decline", "validation_and_policy_converged", "validation_patience_exhausted")


def replay_early_stopping(
    history: DataFrame, min_delta: float, patience: int, min_epochs: int,
    score: str = "score", run: str = "run_id", epoch: str = "epoch",
    tolerance: float | None = None, window: int = 6, reward: str = "reward",
) -> DataFrame:
    """Best epoch with hysteresis, and where the run would have stopped.

    The first of three exits counts: persistent decline, convergence (both as in
    :func:`stability_flags`) and patience; in one epoch they go in this order.
    Without ``tolerance`` there is no reward to judge and patience is the only exit.
    """
    numbered = _first_records(history, score, run, epoch)
    ends = numbered.groupBy(run).agg(
        F.max("_at").alias("_last"), F.min(F.when(F.col(epoch) >= min_epochs, F.col("_at"))).alias("_from"))
    # a span lasts from one accepted epoch to the next; patience ends in the first long one
    accepted = accepted_points(numbered, min_delta, score, run, epoch)
    points = accepted.select(run, "at", F.col("epoch").alias("_e"), F.col("score").alias("_s"))
    spans = points.withColumn("_next", F.lead("at").over(Window.partitionBy(run).orderBy("at"))).join(
        ends.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run"))).drop("_run")
    stop = F.greatest(F.col("at") + patience, F.col("_from"))
    ends_here = F.col("_from").isNotNull() & (stop <= F.col("_last")) & (F.col("_next").isNull() | (stop < F.col("_next")))
    exit_ = F.when(ends_here, F.struct(stop.alias("at"), F.lit(2).alias("why")))
    if tolerance is not None:
        flags = _stability(numbered, accepted, min_delta, tolerance, min_epochs, window, score, reward, run, epoch)
        why = F.when(F.col("declining"), 0).when(F.col("converged"), 1)
        first = flags.groupBy(run).agg(F.min(F.when(why.isNotNull(), F.struct(F.col("_at").alias("at"), why.alias("why")))).alias("_flag"))
        spans = spans.join(first.withColumnRenamed(run, "_run"), F.col(run).eqNullSafe(F.col("_run")), "left").drop("_run")
        flagged = (F.col("_flag.at") >= F.col("at")) & (F.col("_next").isNull() | (F.col("_flag.at") < F.col("_next")))
        exit_ = F.least(exit_, F.when(flagged, F.col("_flag")))
    best = [F.col("_e").alias("epoch"), F.col("_s").alias("score")]
    t = spans.withColumn("_exit", exit_).groupBy(run).agg(
        F.min(F.when(F.col("_exit").isNotNull(), F.struct("_exit.at", "_exit.why", *best))).alias("_stop"),
        F.max(F.struct("at", *best)).alias("_final"), F.max("_last").alias("_last"))
    stopped = F.col("_stop").isNotNull()
    shown = lambda name: F.when(stopped, F.col(f"_stop.{name}")).otherwise(F.col(f"_final.{name}"))
    return t.select(
        run, shown("epoch").alias("best_epoch"), shown("score").alias("best_score"),
        F.when(stopped, F.col("_stop.at")).otherwise(F.col("_last")).alias("validations_used"),
        F.when(stopped, F.get(F.array(*map(F.lit, REASONS)), F.col("_stop.why"))).otherwise("max_epochs_reached").alias("stopping_reason"))


def stability_flags(
    history: DataFrame, min_delta: float, tolerance: float, min_epochs: int, window: int = 6,
    score: str = "score", reward: str = "reward", run: str = "run_id", epoch: str = "epoch", piece: int = 50_000,
) -> DataFrame:
    """Convergence and persistent decline over the last ``window`` validations, each with a score and a reward.

    The frame is short, so a run is cut into pieces by position and the rows
    just before a piece are repeated in it.
    """
    numbered = _first_records(history, score, run, epoch)
    points = accepted_points(numbered, min_delta, score, run, epoch)
    return _stability(numbered, points, min_delta, tolerance, min_epochs, window, score, reward, run, epoch, piece).drop("_at")


def _stability(numbered, points, min_delta, tolerance, min_epochs, window, score, reward, run, epoch, piece=50_000) -> DataFrame:
    """The flags with ``_at``, from the numbered epochs and the accepted points among them."""
    marked = numbered.drop("position", "group_size", "_best_before").join(
        points.select(F.col(run).alias("_run"), "at", F.col("score").alias("_accepted")),
        F.col(run).eqNullSafe(F.col("_run")) & (F.col("_at") == F.col("at")), "left").drop("_run", "at")
    rows = positioned(marked, [run], epoch, maxima={"_max": "_accepted"})
    rows = rows.withColumn("best_so_far", F.greatest("_max", "_accepted"))
    own = F.floor(F.col("position") / piece)
    near_end = F.col("position") % piece >= piece - (window - 1)
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumn("_own", own).withColumn("_piece", F.explode(copies))
    ordered = Window.partitionBy(run, "_piece").orderBy("position")
    frame = ordered.rowsBetween(-(window - 1), 0)
    cut = cut.withColumn("_prev", F.lag(score).over(ordered)).withColumns({
        "_n": F.count(F.when(F.col(reward).isNotNull(), F.col(score))).over(frame), "_hi": F.max(score).over(frame), "_lo": F.min(score).over(frame),
        "_rhi": F.max(reward).over(frame), "_rlo": F.min(reward).over(frame), "_ravg": F.avg(reward).over(frame)})
    falls = (F.col(score) <= F.col("_prev") + min_delta * 0.25).cast("int")
    cut = cut.withColumn("_falls", F.sum(falls).over(ordered.rowsBetween(-(window - 2), 0)))
    full = (F.col("_n") == window) & (F.col(epoch) >= min_epochs)
    reference = F.greatest(F.abs("_ravg"), F.lit(1.0))
    flat = (F.col("_hi") - F.col("_lo") <= tolerance) & (
        F.col("_rhi") - F.col("_rlo") <= F.greatest(F.lit(tolerance), reference * 0.0025))
    converged = full & flat & (F.col("_hi") <= F.col("best_so_far") + min_delta)
    declines = full & (F.col(score) < F.col("best_so_far") - min_delta) & (F.col("_falls") == window - 1)
    return cut.filter(F.col("_own") == F.col("_piece")).select(
        run, epoch, "_at", "best_so_far", F.coalesce(converged, F.lit(False)).alias("converged"),
        F.coalesce(declines, F.lit(False)).alias("declining"))


def steps_to_threshold(history: DataFrame, target: float, value: str, updates: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """First epoch of each run at or above the target, N/A when there is none."""
    reached = F.when(finite(F.col(value)) >= target, F.col(epoch))
    t = history.groupBy(run).agg(F.min(reached).alias("epoch"), F.min_by(updates, reached).alias("updates"))
    return t.withColumn("status", F.when(F.col("epoch").isNull(), "N/A").otherwise("available"))


def latest_by_time(df: DataFrame, key: str, columns: Sequence[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; one buffer per key, no sort."""
    row = F.max_by(F.struct(*columns), F.struct(F.col(time), F.col(tie)))
    return df.groupBy(key).agg(row.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def best_points(history: DataFrame, score: str, reward: str, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Best score with its first epoch, and best reward."""
    value = finite(F.col(score))
    first = F.when(value.isNotNull(), F.struct(value.alias("v"), -F.col(epoch)))
    return history.groupBy(run).agg(
        F.max_by(epoch, first).alias("best_epoch"), F.max(value).alias("best_score"), F.max(finite(F.col(reward))).alias("best_reward"))


def cumulative_updates(history: DataFrame, updates: str = "updates", run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    return positioned(history, [run], epoch, totals={"total_updates": updates})


def action_share(history: DataFrame, keys: Sequence[str], action: str, actions: Sequence[str]) -> DataFrame:
    """Share of every action per key; the denominator is 1 when a key is empty."""
    n = history.groupBy(*keys).agg(
        F.count(action).alias("_all"), *[F.count_if(F.col(action) == a).alias(a) for a in actions])
    whole = F.greatest(F.col("_all"), F.lit(1))
    shares = n.select(*keys, *[(F.col(a) / whole).alias(a) for a in actions])
    return shares.unpivot(list(keys), list(actions), "action", "share")


def iqm(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean without floor(n/4) values at both ends, from four values on."""
    ranked = ranked_values(df.withColumn(value, finite(F.col(value))), keys, value)
    trim = F.when(F.col("total") >= 4, F.floor(F.col("total") * 0.25)).otherwise(0)
    low = F.greatest(F.col("below"), trim)
    high = F.least(F.col("below") + F.col("copies"), F.col("total") - trim)
    kept = F.greatest(high - low, F.lit(0))
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col(value) * kept) / F.sum(kept)).alias("iqm"), F.max("total").alias("n"))


def _scattered(df: DataFrame, name: str) -> DataFrame:
    """Scatter a 31-bit column by two rounds of multiply and shift, one column at a time to keep the code short."""
    x = F.col(name)
    for _ in range(2):
        df = df.withColumn(name, x.bitwiseXOR(F.shiftright(x, 16)))
        df = df.withColumn(name, (x * F.lit(73244475)).bitwiseAND(F.lit(HASH_MASK)))
    return df.withColumn(name, x.bitwiseXOR(F.shiftright(x, 16)))


def bootstrap_ci(df: DataFrame, group: str, value: str, reps: int = 10_000, seed: int = 20260818) -> DataFrame:
    """Percentile bootstrap of the mean, one row per group, by Poisson weights.

    In every replication each value counts Poisson(1) times. The weight is a hash of seed, group, place of the value
    in its group and replication, so the interval depends neither on partitions nor on the size of a group. Weighted
    sums are formed map-side and one row per task, group and replication is shuffled. A replication without any value
    (possible in groups of a few) is left out.
    """
    rows = df.select(group, finite(F.col(value).cast("double")).alias("_v")).filter(F.col("_v").isNotNull())
    placed = positioned(rows, [group], "_v")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), 1, 7), 16, 10)
    place = (start.cast("long") + F.col("position").bitwiseAND(F.lit(HASH_MASK)) * F.lit(1103515245)).bitwiseAND(F.lit(HASH_MASK))
    placed = _scattered(placed.select(group, "_v", place.alias("_h")), "_h")
    drawn = placed.select(group, "_v", "_h", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    u = (F.col("_h") + F.col("rep").cast("long") * F.lit(1664525)).bitwiseAND(F.lit(HASH_MASK))
    drawn = _scattered(drawn.select(group, "rep", "_v", u.alias("_u")), "_u")
    weight, edge, term = F.lit(0), 0.0, 2.718281828459045**-1
    for i in range(13):  # the inverse distribution function of Poisson(1), as far as 31 bits tell values apart
        edge += term
        weight = weight + (F.col("_u") >= F.lit(min(int(edge * (HASH_MASK + 1)), HASH_MASK))).cast("int")
        term /= i + 1
    means = drawn.select(group, "rep", "_v", weight.alias("_w")).groupBy(group, "rep").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n")).filter("_n > 0")
    ranked = means.select(
        F.col(group).alias("_g"), (F.col("_s") / F.col("_n")).alias("mean")).withColumns({  # ``reps`` rows per group
            "_rank": F.row_number().over(Window.partitionBy("_g").orderBy("mean")) - 1,
            "_all": F.count(F.lit(1)).over(Window.partitionBy("_g"))})
    at = lambda q: F.floor(F.lit(q) * (F.col("_all") - 1))
    bounds = ranked.groupBy("_g").agg(
        F.max(F.when(F.col("_rank") == at(0.025), F.col("mean"))).alias("lower"),
        F.max(F.when(F.col("_rank") == at(0.975), F.col("mean"))).alias("upper"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.join(bounds, F.col(group).eqNullSafe(F.col("_g")), "left")
    few = F.col("n") < 2
    return out.select(
        group, "n", F.when(~few, F.col("lower")).alias("lower"), F.when(~few, F.col("upper")).alias("upper"),
        F.when(few, "N/A").otherwise("available").alias("status"), F.when(few, "needs two or more results").alias("reason"))


def final_return_stats(history: DataFrame, value: str, run: str = "run_id", epoch: str = "epoch", n: int = 10) -> DataFrame:
    """Mean, IQM and last of the last ``n`` returns of each run."""
    points = last_n(history.filter(finite(F.col(value)).isNotNull()), n, run, epoch)
    whole = F.array_sort(F.collect_list(F.col(value)))  # at most ``n`` values
    t = points.groupBy(run).agg(
        whole.alias("_v"), F.avg(value).alias("mean_last"), F.max_by(value, epoch).alias("final_return"))
    size = F.size("_v")
    trim = F.when(size >= 4, F.floor(size * 0.25)).otherwise(0).cast("int")
    kept = F.slice("_v", trim + 1, size - 2 * trim)
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)
    return t.select(run, size.cast("long").alias("points"), "mean_last", mean.alias("iqm_last"), "final_return")


def per_seed_results(runs: DataFrame, history: DataFrame, value: str, run: str = "run_id") -> DataFrame:
    """One row per run that has a seed: final return and mean of the last ten."""
    stats = final_return_stats(history, value, run).select(run, "final_return", F.col("mean_last").alias("mean_last_10"))
    return runs.filter(F.col("seed").isNotNull()).select(run, "seed").join(stats, run)


def performance_profile(results: DataFrame, value: str, thresholds: Sequence[float], seed: str = "seed") -> DataFrame:
    """Share of runs at or above each threshold; null with fewer than two seeds."""
    held = finite(F.col(value))
    seeds = F.count_distinct(F.when(held.isNotNull(), F.col(seed))).alias("seeds")
    points = [
        F.struct(F.lit(float(t)).alias("threshold"), F.avg(F.when(held >= t, 1.0).when(held.isNotNull(), 0.0)).alias("share"))
        for t in thresholds]
    t = results.agg(seeds, F.array(*points).alias("a")).select("seeds", F.inline("a"))
    return t.select(
        "threshold", F.when(F.col("seeds") >= 2, F.col("share")).alias("share"), "seeds",
        F.when(F.col("seeds") >= 2, "available").otherwise("N/A").alias("status"))


def run_catalog(runs: DataFrame, time_columns: Sequence[str]) -> DataFrame:
    """Runs newest first; the time is the first readable one of the candidates."""
    from triagemill.functions.missing import event_time

    times = [F.unix_micros(event_time(F.col(c).cast("string"))) for c in time_columns if c in runs.columns]
    stamp = F.coalesce(*[F.when(t != 0, t) for t in times], F.lit(0))
    return runs.withColumn("sort_micros", stamp).orderBy(F.desc("sort_micros"), "run_id")


def dashboard_summary(history: DataFrame, scored: DataFrame, decisions: DataFrame, rewards: DataFrame) -> DataFrame:
    """The ten key figures in one row; each input is one aggregate."""
    last = history.agg(F.max_by("rows_seen", "epoch").alias("rows_seen"), F.max("epoch").alias("epoch"), F.count(F.lit(1)).alias("n"))
    test = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("reward").alias("average_reward"), F.avg("latency_ms").alias("average_latency"))
    h = last.select(F.struct("*")).scalar()
    n_decisions = decisions.agg(F.count(F.lit(1))).scalar()
    n_rewards = rewards.agg(F.count(F.lit(1))).scalar()
    t = test.withColumns({"_h": h, "total_decisions": n_decisions, "total_rewards": n_rewards})
    return t.select(
        (F.coalesce(F.col("_h.rows_seen"), F.lit(0)) + F.col("rows")).alias("total_alerts"),
        F.col("rows").alias("processed_alerts"), "total_decisions", "total_rewards",
        F.coalesce("average_reward", F.lit(0.0)).alias("average_reward"),
        F.coalesce("average_latency", F.lit(0.0)).alias("average_latency"),
        F.lit(0.0).alias("accuracy"), F.lit("healthy").alias("database_status"),
        F.when(F.col("_h.n") > 0, "completed").otherwise("not_trained").alias("training_status"),
        F.coalesce(F.col("_h.epoch"), F.lit(0)).alias("current_episode"))
