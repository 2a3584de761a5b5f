"""Missing values, safe numbers, event times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: texts that count as missing
MISSING_TEXTS = ["", "nan", "NaN"]


def present(value: Column) -> Column:
    """The value as text, null when it stands for 'missing'."""
    text = value.cast("string")
    return F.when(~text.isin(MISSING_TEXTS), text)


def first_present(df: DataFrame, out: str, names: Sequence[str], trim: bool = False) -> DataFrame:
    """First non-missing of those alias columns that exist in ``df``."""
    found = [present(F.col(n)) for n in names if n in df.columns]
    value = F.coalesce(*found) if found else F.lit(None).cast("string")
    return df.withColumn(out, F.trim(value) if trim else value)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    infinite = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) != infinite), value)


def absent(df: DataFrame, name: str) -> Column:
    """Whether a cell is missing: null, or NaN in a column of floats."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def number(text: Column) -> Column:
    """Parse a finite number, null when there is none."""
    return finite(text.try_cast("double"))


def finite_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply :func:`finite` to numbers and arrays of numbers, parse texts first."""
    changed = {}
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            changed[name] = F.transform(name, finite)
        elif isinstance(kind, T.StringType):
            changed[name] = number(F.col(name))
        else:
            changed[name] = finite(F.col(name))
    return df.withColumns(changed)


def event_time(value: Column) -> Column:
    """Epoch seconds or ISO-8601 text ('Z' allowed) to an instant; null when neither."""
    seconds = number(value)
    return F.coalesce(
        F.timestamp_micros((seconds * 1e6).cast("long")),
        F.when(seconds.isNull(), F.try_to_timestamp(value)),
    )


def parse_event_time(df: DataFrame, column: str, out: str, default_epoch: bool = False) -> DataFrame:
    """``default_epoch`` gives 1970-01-01 for unreadable times, as run sorting wants."""
    parsed = event_time(F.col(column).cast("string"))
    return df.withColumn(out, F.coalesce(parsed, F.timestamp_seconds(F.lit(0))) if default_epoch else parsed)


def unreadable_times(df: DataFrame, column: str) -> DataFrame:
    """Strict mode: the count that must be zero before a load is accepted."""
    bad = event_time(F.col(column).cast("string")).isNull()
    return df.agg(F.count_if(bad).alias("unreadable"), F.count(F.lit(1)).alias("rows"))


def calendar_features(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumns({
        "hour": F.hour(time).cast("long"),
        "day": F.day(time).cast("long"),
        "month": F.month(time).cast("long"),
        "is_weekend": (F.weekday(time) >= 5).cast("long"),
    })
