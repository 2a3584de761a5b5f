"""Category codes, scaling and state vectors, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.functions.missing import finite
from triagemill.operators.ordered import ranked_by_range
from triagemill.session import BROADCAST_BYTES, BROADCAST_ROWS, settle, sized_join

WIDE_COLUMN = 100_000  # distinct values from which a column is ranked by ranges


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of all columns in one pass, null counted as 'Unknown'."""
    wide = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "value").distinct()


def _ranked(values: DataFrame) -> DataFrame:
    """(column, value) with ``rank`` from 0 in the code-point order of a column's values; the input is settled.

    Columns of ordinary width are ranked by a window per column; very wide ones by ranges of the whole value.
    """
    sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [c for c, n in sizes.items() if n > WIDE_COLUMN]
    usual = values.filter(~F.col("column").isin(wide)) if wide else values
    ranked = usual.withColumn("rank", (F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1).cast("long"))
    if wide:
        dealt = ranked_by_range(values.filter(F.col("column").isin(wide)), ["column"], "value")
        ranked = ranked.unionByName(dealt.withColumnRenamed("position", "rank"))
    return ranked


def fit_codebook(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): codes follow the code-point order of the values, which are settled once."""
    values = settle(distinct_values(train, columns), "values")
    return settle(_ranked(values).withColumnRenamed("rank", "code"), "codebook")


def _coded(df: DataFrame, codebook: DataFrame, columns: Sequence[str], code) -> DataFrame:
    """Left join each column with its part of the codebook.

    The parts are counted first: a short one is broadcast, a long one is joined
    by a shuffle, where adaptive execution splits skewed values.
    """
    size = F.struct(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes"))
    sizes = {r["column"]: r["size"] for r in codebook.groupBy("column").agg(size.alias("size")).collect()}  # per column
    for c in columns:
        part = codebook.filter(F.col("column") == c).select(F.col("value").alias(f"_t_{c}"), F.col("code").alias(f"_c_{c}"))
        known = sizes.get(c)
        if known is None or (known["rows"] <= BROADCAST_ROWS and known["bytes"] <= BROADCAST_BYTES):
            part = F.broadcast(part)
        text = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
        df = df.withColumn(f"_t_{c}", text).join(part, f"_t_{c}", "left")
        df = df.withColumn(f"{c}_code", code(c, F.col(f"_c_{c}"))).drop(f"_t_{c}", f"_c_{c}")
    return df


def apply_codebook(df: DataFrame, codebook: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes as ``<column>_code``; a value unseen in training gets -1."""
    return _coded(df, codebook, columns, lambda c, code: F.coalesce(code, F.lit(-1)).cast("long"))


def apply_codebook_bucketed(df: DataFrame, codebook: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes scaled to (0, 1]; unseen values share the bucket above the highest code.

    A numeric input column is taken as already coded; a boolean one is refused.
    """
    for c in columns:
        if isinstance(df.schema[c].dataType, T.BooleanType):
            raise ValueError(f"{c}: a boolean is neither a source value nor a code")
    tops = codebook.groupBy("column").agg(F.max("code").alias("m"))
    top_of = tops.agg(F.map_from_entries(F.collect_list(F.struct("column", "m")))).scalar()  # one entry per column
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in columns if c not in numeric]

    def size(c: str) -> Column:
        return F.greatest(F.lit(1.0), F.coalesce(F.element_at(top_of, F.lit(c)), F.lit(0)) + 1.0)

    out = _coded(df, codebook, texts, lambda c, code: F.coalesce(code.cast("double"), size(c)) / size(c))
    return out.withColumns({f"{c}_code": F.col(c).cast("double") / size(c) for c in numeric}) if numeric else out


def recover_codebook(raw: DataFrame, processed: DataFrame, key: str, column: str) -> DataFrame:
    """Raw value, code and number of codes, learnt from rows aligned by key."""
    pairs = raw.select(key, F.col(column).cast("string").alias("value")).join(
        processed.select(key, F.col(f"{column}_code").alias("code")), key)
    return pairs.groupBy("value").agg(F.min("code").alias("code"), F.count_distinct("code").alias("codes"))


def require_one_to_one(recovered: DataFrame) -> DataFrame:
    bad = recovered.filter("codes > 1").limit(1).count()
    if bad:
        raise ValueError("a raw value has more than one code")
    return recovered


def fit_minmax(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct (min, max) of the finite values per column."""
    return train.agg(*[
        F.struct(F.min(finite(F.col(c).cast("double"))).alias("min"), F.max(finite(F.col(c).cast("double"))).alias("max")).alias(c)
        for c in columns])


def apply_minmax(df: DataFrame, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_scaled``: 0 for a constant column, null for a value that is not finite, never clipped."""
    out = df.withColumn("_r", ranges.select(F.struct("*")).scalar())
    scaled = {}
    for c in columns:
        low, high = F.col("_r")[c]["min"], F.col("_r")[c]["max"]
        value = finite(F.col(c).cast("double"))
        scaled[f"{c}_scaled"] = F.when(high == low, 0.0).otherwise((value - low) / (high - low))
    return out.withColumns(scaled).drop("_r")


def fit_zscore(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation per column; tiny deviations become 1."""
    parts = []
    for c in columns:
        value = finite(F.col(c).cast("double"))
        std = F.stddev_pop(value)
        parts.append(F.struct(F.avg(value).alias("mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("std")).alias(c))
    return train.agg(*parts)


def apply_zscore(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.withColumn("_s", stats.select(F.struct("*")).scalar())
    return out.withColumns(
        {f"{c}_z": (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"] for c in columns}).drop("_s")


def assemble_state(df: DataFrame, features: Sequence[str], out: str = "state", strict: bool = True) -> DataFrame:
    """Ordered feature vector; a missing column or value is an error when strict."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError("missing features: " + ", ".join(missing))
    cells = [F.col(f).cast("double") for f in features]
    if strict:
        cells = [F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"feature {f} is missing")).cast("double"))
                 for f, c in zip(features, cells)]
    return df.withColumn(out, F.array(*cells))


def categorical_features(train: DataFrame, features: Sequence[str], limit: int = 100) -> list[str]:
    """Text columns, and columns with fewer than ``limit`` distinct values (null counts)."""
    texts = [f for f in features if isinstance(train.schema[f].dataType, T.StringType)]
    others = [f for f in features if f not in texts]
    if not others:
        return texts
    sizes = train.agg(*[
        (F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in others]).first()
    return [f for f in features if f in texts or sizes[f] < limit]


def fit_one_hot(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, value, index): categories in code-point order; those seen once in training share the index behind."""
    counts = settle(
        train.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in categorical])
        .unpivot([], list(categorical), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "categories")
    own = settle(_ranked(counts.filter("n > 1").select("column", "value")), "own")
    sizes = own.groupBy("column").agg(F.count(F.lit(1)).alias("_size"))  # a row per column
    rare = counts.filter("n = 1").join(sizes, "column", "left").select(
        "column", "value", F.coalesce("_size", F.lit(0)).cast("long").alias("index"))
    return settle(own.withColumnRenamed("rank", "index").unionByName(rare), "one-hot")


def one_hot(train: DataFrame, test: DataFrame, features: Sequence[str], out: str = "features"):
    """One-hot vectors of categorical columns, other columns passed through.

    Categories seen once in training are pooled with each other; categories of
    the test rows that training never saw get an all-zero block. Indices come
    from a join with the settled table of categories, so no label passes
    through the driver, and the vectors are sparse.
    """
    categorical = categorical_features(train, features)
    plain = [f for f in features if f not in categorical]
    book = fit_one_hot(train, categorical)
    sizes = {r["column"]: r["n"] for r in book.groupBy("column").agg((F.max("index") + 1).alias("n")).collect()}  # per column

    def indexed(df: DataFrame) -> DataFrame:
        for c in categorical:
            part = settle(book.filter(F.col("column") == c).select(F.col("value").alias("_x"), F.col("index").alias("_n")), "part")
            df = sized_join(df.withColumn("_x", F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))), part, ["_x"])
            df = df.withColumn(f"_i_{c}", F.coalesce("_n", F.lit(sizes.get(c, 0))).cast("double")).drop("_x", "_n")
        return df

    train_i = indexed(train)
    # an index beyond those of training is invalid for the encoder: the extra category is the last one, which it drops
    encoder = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], handleInvalid="keep")
    encoder = encoder.fit(train_i)
    parts = VectorAssembler(inputCols=[f"_h_{c}" for c in categorical] + plain, outputCol=out, handleInvalid="keep")

    def encode(df: DataFrame) -> DataFrame:
        return parts.transform(encoder.transform(df)).drop(*[f"{p}{c}" for p in ("_i_", "_h_") for c in categorical])

    return encode(train_i), encode(indexed(test))
