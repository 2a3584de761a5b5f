"""Gated decisions, records, events and load-balanced routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.constants import ACTIONS, CONFIDENCE_THRESHOLD, MARGIN_THRESHOLD
from triagemill.functions.rewards import action_name
from triagemill.functions.scoring import (
    first_of_three, gate_parts, hash_uniform, last_of_three)
from triagemill.operators.ordered import positioned
from triagemill.session import settle, sized_join


def gate_decision(
    df: DataFrame, confidence: float = CONFIDENCE_THRESHOLD, margin: float = MARGIN_THRESHOLD,
) -> DataFrame:
    """Probabilities, top action, and the action after the two gates.

    The top action is the last maximum. A human review is never gated.
    """
    q = (F.col("q0"), F.col("q1"), F.col("q2"))
    parts = gate_parts(*q)
    out = df.withColumns({
        "_mass": parts["mass"], "_second": parts["second"], "top_action": last_of_three(*q)})
    out = out.withColumns({
        "confidence": 1.0 / F.col("_mass"), "action_margin": 1.0 / F.col("_mass") - F.col("_second") / F.col("_mass"),
        **{f"p_{name}": weight / F.col("_mass") for name, weight in zip(ACTIONS, parts["weights"])}})
    out = out.drop("_mass", "_second")
    reason = F.when(
        F.col("top_action") != 2,
        F.when(F.col("confidence") < confidence, "LOW_CONFIDENCE").when(F.col("action_margin") < margin, "LOW_MARGIN"))
    gated = F.when(reason.isNotNull(), 2).otherwise(F.col("top_action")).cast("long")
    # as a generator's output the two are computed once: a filter on what follows from them would else repeat the
    # whole soft-max in every place they are named, beyond what generated code can hold
    made = F.inline(F.array(F.struct(reason.alias("uncertainty_reason"), gated.alias("action_code"))))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in ("uncertainty_reason", "action_code")], made)


def decision_record(
    gated: DataFrame, version: str, algorithm: str, cycle_id: Column,
    confidence: float = CONFIDENCE_THRESHOLD, margin: float = MARGIN_THRESHOLD,
) -> DataFrame:
    """Status, names, value and probability maps, thresholds and provenance."""
    names = F.array(*[F.lit(a) for a in ACTIONS])
    code = F.col("action_code")
    status = F.when(code == 2, "HUMAN_REVIEW_PENDING").when(code == 0, "MODEL_ALLOWED").otherwise("MODEL_BLOCKED")
    return gated.withColumns({
        "status": status, "action": action_name(code), "model_action": action_name(F.col("top_action")),
        "requires_human_review": code == 2,
        "q_values": F.map_from_arrays(names, F.array("q0", "q1", "q2")),
        "action_probabilities": F.map_from_arrays(names, F.array("p_allow", "p_block", "p_human_review")),
        "confidence_threshold": F.lit(confidence), "margin_threshold": F.lit(margin),
        "model_version": F.lit(version), "algorithm": F.lit(algorithm), "cycle_id": cycle_id,
        "agent_status": F.lit("INFERRED")})


def _stretches(staff: DataFrame, low: str, high: str | None, reviews: Column) -> DataFrame:
    """Stretches of levels on which the same people take places, as one row of two arrays, ``at`` and ``first``.

    A person takes one place on each level from ``low`` up to ``high`` (without end if None). Between two
    neighbouring ends nobody joins or leaves, so the places before a level follow from sums over the ends: at most
    two rows a person. Only stretches that start before the last review are kept.
    """
    ends = staff.select(F.col(low).alias("at"), F.lit(1).alias("d"))
    if high:
        ends = ends.unionByName(staff.select(F.col(high).alias("at"), F.lit(-1).alias("d")))
    ends = ends.groupBy("at").agg(F.sum("d").alias("d"))
    line = F.array_sort(F.collect_list(F.struct("at", "d")))

    def step(s: Column, x: Column) -> Column:
        # a stretch without people has no places; the product stays below the reviews where it matters
        wide = (x["at"] - s["at"]).cast("decimal(20,0)") * s["people"]
        first = F.least(s["first"] + F.coalesce(wide, F.lit(0)), reviews.cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.struct(
            x["at"].alias("at"), (s["people"] + x["d"]).alias("people"), first.alias("first"),
            F.concat(s["done"], F.array(F.struct(x["at"].alias("at"), first.cast("long").alias("first"), (s["people"] + x["d"]).alias("people")))).alias("done"))

    zero = F.struct(
        F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("people"), F.lit(0).cast("decimal(38,0)").alias("first"),
        F.array().cast("array<struct<at:bigint,first:bigint,people:bigint>>").alias("done"))
    done = F.aggregate(line, zero, step, lambda s: s["done"])
    return ends.agg(F.filter(done, lambda x: (x["people"] > 0) & (x["first"] < reviews)).alias("steps"), F.try_element_at(done, F.lit(-1))["first"].alias("all"))


def _last_at_or_below(values: Column, x: Column, most: int) -> Column:
    """Place of the last of the sorted values that is at or below ``x``, by halving; -1 if none is."""
    halves = [1 << i for i in reversed(range(max(most, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(-1),
        lambda at, h: F.when(F.get(values, at + h) <= x, at + h).otherwise(at))


def route_to_analysts(reviews: DataFrame, workload: DataFrame, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Give the reviews, in time order, to the analyst who is least loaded at that moment.

    ``workload`` has analyst_id, capacity and load. The one-by-one rule takes free places in the order (load, -room,
    id) and, when all are full, levels everyone up in the order (load, id). Like water, the level rises through
    stretches on which the same people take a place on each level. The stretch of the i-th review is found by halving,
    its rank on the level by a division, and the person by a join with the people of the stretch in their order. Each
    stretch but the last is filled with reviews, so this table has no more rows than reviews and people together,
    whatever capacities and loads are.
    """
    n = reviews.count()
    staff = settle(workload.select(
        "analyst_id", F.coalesce("capacity", F.lit(0)).cast("long").alias("cap"),
        F.coalesce("load", F.lit(0)).cast("long").alias("load")).withColumn("start", F.greatest("load", "cap")), "staff")
    free = _stretches(staff.filter("load < cap"), "load", "cap", F.lit(n)).first()
    places = free["all"] or 0
    full = _stretches(staff, "start", None, F.lit(max(n - places, 0))).first()
    kinds = [("f", free["steps"] or [], 0), ("l", full["steps"] or [], places)]  # at most two rows a person

    steps = [(kind, at, first + base, people) for kind, some, base in kinds for at, first, people in some]
    spark = reviews.sparkSession
    one = spark.createDataFrame([([s[1] for s in steps], [s[2] for s in steps], [s[3] for s in steps])], "at array<bigint>, first array<bigint>, people array<bigint>")
    one = settle(one, "stretches")
    people = []
    for kind, low, high in (("f", "load", "cap"), ("l", "start", None)):
        own = [i for i, s in enumerate(steps) if s[0] == kind]
        if not own:
            continue
        levels = F.col("_levels")
        # the stretches from the first that starts at or above ``low`` to the last that starts below ``high``
        start = _last_at_or_below(levels, F.col(low) - 1, len(own)) + 1
        end = _last_at_or_below(levels, F.col(high) - 1, len(own)) if high else F.lit(len(own) - 1)
        some = staff.filter("load < cap") if high else staff
        some = some.withColumn("_levels", F.slice(one.select("at").scalar(), own[0] + 1, len(own)))
        some = some.select("analyst_id", "cap", start.alias("_from"), end.alias("_to")).filter("_from <= _to")
        some = some.select("analyst_id", "cap", F.explode(F.sequence(F.col("_from"), F.col("_to"))).alias("_s"))
        order = Window.partitionBy("_s").orderBy(*([F.desc("cap")] if high else []), "analyst_id")
        people.append(some.select(
            (F.col("_s") + own[0]).alias("_stretch"), (F.row_number().over(order) - 1).cast("long").alias("_rank"),
            F.col("analyst_id").alias("assigned_analyst")))
    lined = positioned(reviews, [], time, tie)
    if not people:
        return lined.withColumn("assigned_analyst", F.lit(None).cast(staff.schema["analyst_id"].dataType)).drop("group_size")
    people = settle(reduce(DataFrame.unionByName, people), "people")
    lined = lined.withColumns({"_first": one.select("first").scalar(), "_width": one.select("people").scalar()})
    lined = lined.withColumn("_stretch", _last_at_or_below(F.col("_first"), F.col("position"), len(steps)))
    rank = (F.col("position") - F.get("_first", F.col("_stretch"))) % F.get("_width", F.col("_stretch"))
    lined = lined.withColumn("_rank", rank).drop("_first", "_width", "group_size")
    return sized_join(lined, people, ["_stretch", "_rank"]).drop("_stretch", "_rank")


def undecided(alerts: DataFrame, cycle_id: str | None = None) -> DataFrame:
    waiting = F.col("agent_status").isNull() | (F.col("agent_status") == "WAITING_INFERENCE")
    return alerts.filter(waiting if cycle_id is None else waiting & (F.col("cycle_id") == cycle_id))


def split_bad_rows(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all features, and error rows naming what is missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features]))
    any_missing = F.lit(False)
    for f in features:
        any_missing = any_missing | F.col(f).isNull()
    bad = df.filter(any_missing).withColumn("error", F.concat(F.lit("missing features: "), F.concat_ws(", ", missing)))
    return df.filter(~any_missing), bad


def decide_batch(
    alerts: DataFrame, score, workload: DataFrame, features: list[str], version: str = "v1", algorithm: str = "lookup",
    cycle_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decide all waiting alerts: ``(decisions, errors)``.

    ``score`` maps the alerts to the same rows with q0, q1 and q2. Only reviews
    take part in the routing; the other decisions skip its shuffle.
    """
    good, bad = split_bad_rows(undecided(alerts, cycle_id), features)
    gated = gate_decision(score(good))
    records = decision_record(gated, version, algorithm, F.col("cycle_id"))
    records = settle(records, "decisions")  # read by both branches and by the callers
    routed = route_to_analysts(records.filter("requires_human_review").drop("assigned_analyst"), workload).drop("position")
    others = records.filter("not requires_human_review").withColumn("assigned_analyst", F.lit(None).cast("string"))
    return routed.unionByName(others.select(*routed.columns)), bad


def decision_events(decisions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One inference event per decision, one routing event per review, one per error."""
    none = F.lit(None).cast("string")

    def event(seq, action, actor, details):
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), *details)

    inference = event(1, "AGENT_INFERENCE", "agent", [
        F.col("action").alias("decided"), F.col("uncertainty_reason").alias("reason"), none.alias("analyst_id")])
    routing = event(2, "HUMAN_REVIEW_ROUTED", "system", [
        none.alias("decided"), F.coalesce("uncertainty_reason", F.lit("MODEL_REQUESTED_REVIEW")).alias("reason"),
        F.col("assigned_analyst").alias("analyst_id")])
    events = F.array(inference, F.when(F.col("requires_human_review"), routing))
    out = decisions.select("alert_id", "cycle_id", "ts", F.inline(events)).filter("action is not null")
    if errors is not None:
        failed = event(1, "AGENT_INFERENCE_ERROR", "system", [
            none.alias("decided"), F.col("error").alias("reason"), none.alias("analyst_id")])
        out = out.unionByName(errors.select("alert_id", "cycle_id", "ts", F.inline(F.array(failed))))
    return out


def epsilon_at(step: Column, start: float = 1.0, decay: float = 0.995, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), F.lit(start) * F.pow(F.lit(decay), step))


def epsilon_greedy(df: DataFrame, epsilon: Column | float, seed: int, key: str = "alert_id") -> DataFrame:
    """Random action with probability epsilon, else the first maximum; reproducible by key."""
    eps = F.lit(epsilon) if isinstance(epsilon, (int, float)) else epsilon
    explore = hash_uniform(F.lit(f"{seed}e"), F.col(key)) < eps
    pick = F.floor(hash_uniform(F.lit(f"{seed}a"), F.col(key)) * len(ACTIONS))
    best = first_of_three(F.col("q0"), F.col("q1"), F.col("q2"))
    return df.withColumns({"explored": explore, "action": F.when(explore, pick).otherwise(best).cast("long")})
