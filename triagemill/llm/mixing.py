"""Mixing sources to target weights by hash thresholds.

The budget is shared among the sources by weight; no target exceeds ``most`` times its source's size, and what one source
cannot take the others share, until none is above.  Within a source every document is taken ``base`` times and those
whose hash lies below the source's threshold once more.  The threshold is found without sorting documents: sizes are
summed by source and by the leading bits of the hash, the bucket in which the budget ends is refined by the next bits,
and so on, until it holds one hash.  A smaller budget gives a subset (thresholds are nested), and reruns agree.

Weights go round in order of the sources' names (code points, null last).

Cases: a null or wordless text has size 0; a null source is a source; documents without id are hashed by their text;
rows with equal hash (repeated rows) are taken or left together; the document at the end of a budget is taken when that
brings the sum nearer; an empty table gives no rows; other columns are kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.llm.common import numbered, sent, words_of
from triagemill.session import settle

WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.size(words_of(text, WORD)).cast("bigint")


def hash_of(key: Column, text: Column) -> Column:
    """60 bits of a digest of the id."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def _targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target, base copies and the rest of the budget as a fraction (rest / parts)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int"))
    sources = settle(sources.select("source", "source_size", weight.cast("decimal(38,0)").alias("w")), "sources")
    big = lambda x: F.lit(int(x)).cast("decimal(38,0)")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    budget, shares = int(total[0]), int(total[1])
    full, parts = F.lit(False), (budget, max(shares, 1))
    cap = F.col("source_size") * F.lit(most)
    while True:  # each round caps more sources, or ends
        full = cap * big(parts[1]) < F.col("w") * big(parts[0])
        met = sources.filter(full).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        now = (budget - int(met[0]), max(shares - int(met[1]), 1))
        if now == parts:
            break
        parts = now
    share = F.col("w") * big(parts[0])  # in units of 1 / parts[1] words
    base = F.when(F.col("source_size") == 0, F.lit(0)).when(full, F.lit(most)).otherwise(
        F.floor(share / (F.col("source_size") * big(parts[1]))))
    base = base.cast("bigint")
    target = F.when(full, cap.cast("double")).otherwise(share.cast("double") / F.lit(float(parts[1])))
    rest = F.when(full | (F.col("source_size") == 0), big(0)).otherwise(
        (share - base.cast("decimal(38,0)") * F.col("source_size") * big(parts[1])).cast("decimal(38,0)"))
    return sources.select("source", "source_size", target.alias("target"), base.alias("base"), rest.alias("rest"), big(parts[1]).alias("parts"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", source: str = "source",
             text: str = "text") -> DataFrame:
    """A row per source: source_size, target, base (copies of all its documents) and limit (one more below this hash)."""
    rows = settle(docs.select(
        F.col(source).alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("h")), "sizes")
    plan = settle(_targets(rows, weights, most), "targets")
    open_ = plan.filter("rest > 0").select("source", "rest", "parts", F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("low"))
    limits, within, bits = None, rows, BITS
    while True:
        bits -= STEP
        # sizes by bucket of the next bits, within the bucket where the budget ends (at first, all)
        width = F.lit(1 << bits).cast("bigint")
        ends = sent(settle(open_.withColumnRenamed("source", "_s"), "ends"))
        cells = within.join(ends, F.col("source").eqNullSafe(F.col("_s"))).filter(
            (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * F.lit(1 << STEP))).select(
            "source", "size", "h", "rest", "parts", "before", F.floor(F.col("h") / width).cast("bigint").alias("bucket"))
        if bits < BITS - STEP:
            cells = settle(cells, "cells")
        sums = cells.groupBy("source", "bucket", "rest", "parts", "before").agg(
            F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # at most 4096 buckets
        sums = sums.withColumn("till", F.col("before") + F.sum("size").over(order))
        crossing = sums.filter(F.col("till").cast("decimal(38,0)") * F.col("parts") > F.col("rest"))
        first = crossing.groupBy("source", "rest", "parts").agg(
            F.min(F.struct("bucket", F.expr("till - size").alias("from"), "size", "h0", "h1")).alias("b"))
        first = settle(first.select("source", "rest", "parts", "b.*"), "crossing")
        # one hash is left: its documents are taken when that brings the sum nearer to the budget
        near = (F.col("from") * 2 + F.col("size")).cast("decimal(38,0)") * F.col("parts") <= F.col("rest") * 2
        over = first.filter("h0 = h1").select("source", F.when(near, F.col("h0") + 1).otherwise(F.col("h0")).alias("limit"))
        limits = over if limits is None else limits.unionAll(over)
        open_ = first.filter("h0 < h1").select("source", "rest", "parts", F.col("from").alias("before"), (F.col("bucket") * width).alias("low"))
        if bits == 0 or not open_.take(1):
            break
        within = cells.select("source", "size", "h")
    limits = settle(limits.withColumnRenamed("source", "_s"), "limits")
    out = plan.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    return settle(out.select("source", "source_size", "target", "base", F.coalesce("limit", F.lit(0)).alias("limit")), "plan")


def apply_mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
              prefix: str = "") -> DataFrame:
    """All columns of the documents with size, source_size, target, and copies (how often the mix takes the document).

    Columns of the documents with these names give way; another ``prefix`` of the four keeps them.
    """
    made = [f"{prefix}{c}" for c in ("size", "source_size", "target", "copies")]
    # the documents travel in one column, so that no name of theirs meets one used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("doc")
    sized = docs.select(whole, size_of(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("h"), F.col(source).alias("s"))
    table = sent(plan.select(F.col("source").alias("of"), "source_size", "target", "base", "limit"))
    met = sized.join(table, F.col("s").eqNullSafe(F.col("of")), "left")
    copies = F.col("base") + F.when(F.col("h") < F.col("limit"), F.lit(1)).otherwise(F.lit(0))
    return met.select("doc.*", *[c.alias(name) for c, name in zip((F.col("size"), F.col("source_size"), F.col("target"), copies), made)])
