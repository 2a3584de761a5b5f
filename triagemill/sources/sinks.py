"""Writing tables; every write is replaced as a whole by the job commit, metrics by a commit of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from triagemill.functions.missing import finite_or_null
from triagemill.operators.policy import score_actions
from triagemill.sources.commits import Versions


def write_processed(df: DataFrame, path: str) -> int:
    """Write Parquet and give the number of rows, counted while writing; none is an error."""
    seen = Observation("processed")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = seen.get["rows"]
    if rows == 0:
        raise RuntimeError(f"{path}: no rows found")
    return rows


def write_codebook(codebook: DataFrame, path: str) -> None:
    codebook.write.mode("overwrite").partitionBy("column").parquet(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("column string, value string, code bigint").parquet(path).select("column", "value", "code")
    except AnalysisException as error:
        raise FileNotFoundError(f"no codebook at {path}") from error


def write_metrics_snapshot(df: DataFrame, path: str, keep: int = 2) -> str:
    """Latest metrics as JSON; NaN and infinities become null. Gives the name of the snapshot.

    The rows go to a folder of their own; the commit that follows the whole write makes them the latest at one stroke.
    A write that fails changes nothing for readers. The ``keep`` newest snapshots stay, for readers that have begun.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    versions = Versions(df.sparkSession, path)
    name = versions.fresh()
    try:
        finite_or_null(df, doubles).write.option("ignoreNullFields", False).json(versions.folder(name))
    except Exception:
        versions.drop(name)
        raise
    versions.commit(name)
    versions.keep_newest(keep)
    return name


def read_metrics_snapshot(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The latest whole snapshot."""
    versions = Versions(spark, path)
    name = versions.newest()
    if name is None:
        raise FileNotFoundError(f"no metrics at {path}")
    return spark.read.schema(schema).json(versions.folder(name))


def write_id_sets(split_ids: DataFrame, path: str) -> None:
    """Incident ids per split, sorted inside each file."""
    (split_ids.select("incident_id", "split").distinct().sortWithinPartitions("split", "incident_id")
     .write.mode("overwrite").partitionBy("split").parquet(path))


def predict_and_write(df: DataFrame, score, path: str) -> int:
    """Score, add the action columns, write; gives the number of rows."""
    return write_processed(score_actions(score(df)), path)
