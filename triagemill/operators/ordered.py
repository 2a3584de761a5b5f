"""Order-dependent computations that stay parallel when one key is hot.

A window over ``partitionBy(key)`` puts a whole key into one task. Keys with
more rows than an average partition are found first (at most one per
partition can exist). Without any, the plain window is used. Otherwise the hot
keys are cut into time-ordered blocks at quantiles of their order column, the
windows run inside a block, and a small summary per block carries the running
values from one block to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.session import settle, sized_join

BLOCK = "_block"


def _numeric(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    return F.col(name).cast("double")


def _parts(df: DataFrame, name: str) -> list[Column]:
    """Doubles whose order, one after the other, is the exact order of the column.

    A whole number above 2^53 or a decimal of more than 15 digits (up to 37)
    is its double and what that leaves of it; other types are exact as doubles.
    """
    kind, x = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DecimalType) and kind.precision > 15:
        sql, most, parts = kind.simpleString(), F.lit(0), 1 + (kind.precision - 1) // 15
    elif isinstance(kind, (T.LongType, T.TimestampType, T.TimestampNTZType)):
        x = x if isinstance(kind, T.LongType) else F.unix_micros(x.cast("timestamp"))
        sql, most, parts = "bigint", F.lit((1 << 63) - 1), 2
    else:
        return [_numeric(df, name)]
    out = [x.cast("double")]
    while len(out) < parts:  # a double beyond the type's range stands for the value that is subtracted instead
        x = x - F.coalesce(out[-1].try_cast(sql), most.cast(sql))
        out.append(x.cast("double"))
    return out


def block_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4)


def hot_keys(df: DataFrame, keys: Sequence[str], blocks: int) -> list[int]:
    """Hashes of the keys with more than 1/blocks of all rows; fewer than ``blocks``.

    One pass keeps the candidates (it misses no frequent item), a second pass
    counts them exactly. Both read the key columns only and shuffle nothing but
    these few counts.
    """
    hashed = df.select(F.xxhash64(*keys).alias("_k"))
    # Spark takes no smaller support; with more blocks, a key below it has the rows of a few average partitions at most
    candidates = hashed.freqItems(["_k"], max(1.0 / blocks, 1e-4)).first()[0] or []
    if not candidates:
        return []
    kept = F.when(F.col("_k").isin(candidates), F.col("_k"))
    counts = hashed.groupBy(kept.alias("_k")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    return [r["_k"] for r in counts if r["_k"] is not None and r["n"] * blocks > total]


def order_blocks(df: DataFrame, time: str, tie: str | None = None, blocks: int | None = None) -> DataFrame:
    """Add ``_block``: larger times never get a smaller block; nulls come last.

    ``tie`` (numeric) cuts further where very many rows share one time: such a
    time is itself a quantile, and its rows are sub-divided by ``tie``. Times
    are told apart exactly, also where they are equal as doubles.
    """
    blocks = blocks or block_count(df)
    levels = _parts(df, time) + ([_numeric(df, tie)] if tie else [])
    names = [f"_o{i}" for i in range(len(levels))]
    keys = df.select(*[c.alias(n) for c, n in zip(levels, names)])
    found = keys.approxQuantile(names, [j / blocks for j in range(1, blocks)], 0.1 / blocks)
    cuts = [sorted(set(q)) for q in found]
    out = df.withColumns(dict(zip(names, levels)))
    # order-preserving rank: cuts at or below the value; rows on a cut come first, sub-divided by the next level
    block, width = F.lit(0), 1
    for i in reversed(range(len(levels))):
        value, below, here = F.col(f"_o{i}"), F.col(f"_b{i}"), cuts[i]
        out = _below(out, f"_o{i}", f"_b{i}", here)
        if i + 1 < len(levels):
            lower = F.get(F.array(*[F.lit(c) for c in here]), (below - 1).cast("int")) if here else F.lit(None)
            on_cut = F.coalesce(lower == value, F.lit(False))
            block, width = F.when(on_cut, block).otherwise(F.lit(width)), width + 1
        last = (len(here) + 2) * width - 1
        block, width = F.coalesce(below * width + block, F.lit(last)), last + 1
    return out.withColumn(BLOCK, block.cast("long")).drop(*names, *[f"_b{i}" for i in range(len(levels))])


def _below(df: DataFrame, source: str, target: str, cuts: Sequence[float]) -> DataFrame:
    """How many cuts are at or below the value."""
    if not cuts:
        return df.withColumn(target, F.lit(0).cast("long"))
    edges = [float("-inf"), *cuts, float("inf")]
    tool = Bucketizer(splits=edges, inputCol=source, outputCol=target, handleInvalid="keep")
    return tool.transform(df).withColumn(target, F.col(target).cast("long"))


def _sort(*names: str | None) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names if name]


def positioned(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str | None = None,
    *,
    then: str | None = None,
    following: str | None = None,
    totals: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Number the rows of each key by (time, tie), without one task per key.

    Adds ``position`` (from 0) and ``group_size``. Further, on demand:
    ``following=c`` adds ``next_c``, the value of ``c`` in the next row;
    ``totals={out: c}`` adds running sums of ``c`` up to and with the row;
    ``maxima={out: c}`` adds the greatest ``c`` of all *earlier* rows.
    ``then`` is a last sort column of any type, used inside a block only.
    ``keys`` may be empty: then the whole table is numbered.
    """
    keys = list(keys)
    totals, maxima = totals or {}, maxima or {}
    blocks = blocks or block_count(df)
    if not keys:
        return _by_blocks(df, keys, time, tie, then, following, totals, maxima, blocks)
    hot = hot_keys(df, keys, blocks)
    if not hot:
        return _by_window(df, keys, time, tie, then, following, totals, maxima)
    is_hot = F.xxhash64(*keys).isin(hot)
    usual = _by_window(df.filter(~is_hot), keys, time, tie, then, following, totals, maxima)
    return usual.unionByName(_by_blocks(df.filter(is_hot), keys, time, tie, then, following, totals, maxima, blocks))


def ranked_by_range(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Number the distinct values ``order`` (of any type, not null) of each key, as ``position`` from 0.

    The rows are dealt by ranges of key and value. Spark samples the bounds from whole values, so the ranges are even
    also where all values begin alike. Values are numbered inside a range, and a count per key and range (one row
    each) says how many come before it. ``keys`` are not null.
    """
    keys = list(keys)
    dealt = df.repartitionByRange(*keys, order)
    parts = settle(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    out = sized_join(parts.withColumn("position", place), settle(base, "bases"), [*keys, "_range"])
    return out.withColumn("position", (F.col("position") + F.col("_base")).cast("long")).drop("_range", "_base")


def _by_blocks(df, keys, time, tie, then, following, totals, maxima, blocks) -> DataFrame:
    """Windows inside (key, block), and a per-block summary that links the blocks."""
    cut = order_blocks(df, time, tie, blocks)
    if keys:  # a struct is never null, so rows with a null key find their summary too
        cut = cut.withColumn("_key", F.struct(*keys))
        keys = ["_key"]
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*_sort(time, tie, then))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_row", F.row_number().over(inside))
    for out, source in totals.items():
        local = local.withColumn(out, F.sum(source).over(upto))
    for out, source in maxima.items():
        local = local.withColumn(out, F.max(source).over(before))
    if following:
        local = local.withColumn(f"next_{following}", F.lead(following).over(inside))

    aggregates = [F.count(F.lit(1)).alias("_size")]
    aggregates += [F.sum(c).alias(f"_sum_{o}") for o, c in totals.items()]
    aggregates += [F.max(c).alias(f"_max_{o}") for o, c in maxima.items()]
    if following:
        head = F.struct(F.col(time).isNull(), F.col(time), F.col(tie) if tie else F.lit(0))
        aggregates.append(F.min_by(F.struct(F.col(following).alias("v")), head).alias("_head"))
    summary = cut.groupBy(*keys, BLOCK).agg(*aggregates)
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    chosen = [
        *keys, BLOCK, "_size",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(whole).alias("group_size"),
    ]
    chosen += [F.sum(f"_sum_{o}").over(earlier).alias(f"_before_{o}") for o in totals]
    chosen += [F.max(f"_max_{o}").over(earlier).alias(f"_before_{o}") for o in maxima]
    if following:
        chosen.append(F.lead("_head").over(across).alias("_next_head"))
    joined = local.join(summary.select(*chosen), [*keys, BLOCK])
    out = joined.withColumn("position", F.col("_offset") + F.col("_row") - 1)
    for o in totals:
        out = out.withColumn(o, F.coalesce(F.col(f"_before_{o}"), F.lit(0)) + F.coalesce(F.col(o), F.lit(0)))
    for o in maxima:
        out = out.withColumn(o, F.greatest(F.col(f"_before_{o}"), F.col(o)))
    if following:
        out = out.withColumn(
            f"next_{following}",
            F.when(F.col("_row") == F.col("_size"), F.col("_next_head")["v"]).otherwise(F.col(f"next_{following}")),
        )
    helpers = [c for c in out.columns if c.startswith("_before_")]
    return out.drop(BLOCK, "_row", "_size", "_offset", "_next_head", "_key", *helpers)


def _by_window(df, keys, time, tie, then, following, totals, maxima) -> DataFrame:
    """The same columns by plain windows, for keys that fit a task."""
    inside = Window.partitionBy(*keys).orderBy(*_sort(time, tie, then))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {
        "position": F.row_number().over(inside).cast("long") - 1,
        "group_size": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    if following:
        added[f"next_{following}"] = F.lead(following).over(inside)
    added |= {out: F.coalesce(F.sum(c).over(upto), F.lit(0)) for out, c in totals.items()}
    added |= {out: F.max(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)) for out, c in maxima.items()}
    return df.withColumns(added)


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """Distinct values per key with their count and the number of smaller rows.

    Equal values are merged before the shuffle; ``below`` is the 0-based rank
    of the first copy, ``total`` the number of rows of the key.
    """
    counts = settle(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("copies")),
        "values",
    )
    sums = positioned(counts, keys, value, totals={"upto": "copies"}, blocks=blocks)
    total = counts.groupBy(*keys).agg(F.sum("copies").alias("total"))
    ranked = sums.select(*keys, value, "copies", (F.col("upto") - F.col("copies")).alias("below"))
    if not keys:
        return ranked.withColumn("total", total.scalar())
    same = F.lit(True)
    for k in keys:
        total = total.withColumnRenamed(k, f"_g_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return ranked.join(total, same).drop(*[f"_g_{k}" for k in keys])


def _at_rank(rank: Column, value: str) -> Column:
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("copies")), F.col(value)))


def value_summary(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Count, mean, extremes and exact percentiles (linear interpolation) per key.

    Everything comes from the merged values, so the input is read once, and
    rank arithmetic gathers nothing into one task.
    """
    ranked = ranked_values(df, keys, value)
    aggregates = [
        F.coalesce(F.sum("copies"), F.lit(0)).alias("count"), (F.sum(F.col(value) * F.col("copies")) / F.sum("copies")).alias("mean"),
        F.max(value).alias("max"), F.min(value).alias("min")]
    for out, q in points.items():
        spot = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(spot), F.ceil(spot)
        aggregates += [
            _at_rank(low, value).alias(f"_lo_{out}"), _at_rank(high, value).alias(f"_hi_{out}"),
            F.max(spot - low).alias(f"_w_{out}")]
    found = ranked.groupBy(*keys).agg(*aggregates)
    return found.select(
        *keys, "count", "mean", "max", "min",
        *[
            (F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_w_{o}")).alias(o)
            for o in points
        ],
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Only the percentiles of :func:`value_summary`."""
    return value_summary(df, keys, value, points).select(*keys, *points)
