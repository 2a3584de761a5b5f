"""Reading and checking alert tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from triagemill.constants import RAW_COLUMNS
from triagemill.functions.missing import absent

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def read_alerts(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV scan that fails unless every header equals the schema, in order.

    Categories are read as text, so that a value has one spelling whatever
    file or partition it comes from.
    """
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path))


def scan_pruned(
    df: DataFrame, features: Sequence[str], incident: str = "incident_id", target: str = "grade_code",
) -> DataFrame:
    """Only features, id and target with fixed types; the scan reads no other column."""
    return df.select(
        *[F.col(f).cast("float").alias(f) for f in features],
        F.col(incident).cast("string").alias(incident), F.col(target).cast("long").alias(target))


def contract_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows and missing feature cells in one map-side aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(absent(df, f)).alias(f"missing_{f}") for f in features])


def load_contract(df: DataFrame, required: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The table itself, or an error: absent column, no rows, or a missing feature."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError("missing columns: " + ", ".join(absent))
    counts = contract_report(df, features).first()
    if counts["rows"] == 0:
        raise ValueError("the table is empty")
    empty = [f for f in features if counts[f"missing_{f}"] > 0]
    if empty:
        raise ValueError("missing values in: " + ", ".join(empty))
    return df


def same_columns(train: DataFrame, test: DataFrame, target: str, incident: str) -> bool:
    """Target and id must be in both; tells whether the column order agrees."""
    for df in (train, test):
        for name in (target, incident):
            if name not in df.columns:
                raise ValueError(f"missing column: {name}")
    return list(train.columns) == list(test.columns)


def file_lineage(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    """(role, path, exists, files, bytes) per input; contents are not read."""
    out = None
    for role, path in roles.items():
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            one = found.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        except AnalysisException:
            one = spark.range(1).select(F.lit(0).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes"))
        one = one.select(
            F.lit(role).alias("role"), F.lit(path).alias("path"), (F.col("files") > 0).alias("exists"), "files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out
