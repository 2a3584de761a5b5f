"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a side may be broadcast up to these counted sizes; beyond them the join is shuffled
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


_local_folder: list[str] = []  # used in local mode only, when no shared folder is named


def get_session(app: str = "triagemill", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution; every setting can be overridden."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local-mode session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="triagemill-"))
    return _local_folder[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/triagemill/{label}-{uuid.uuid4().hex}"


_collected: list[list[str]] = []  # open collections of scratch paths, the innermost last


@contextmanager
def collecting(paths: list[str]) -> Iterator[list[str]]:
    """Note the paths of all tables that are settled meanwhile, so that they can be dropped when they are used up."""
    _collected.append(paths)
    try:
        yield paths
    finally:
        _collected.pop()


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables; the list is empty afterwards."""
    new, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    while paths:
        path = new(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives the loss of executors, is computed once however many
    plans use it, and carries its true size, so that Spark itself decides
    between a broadcast and a shuffled join from the measured bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _collected:
        _collected[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(table: DataFrame) -> bool:
    """Count the rows and text bytes of a settled table against the limits."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(4)) for c in table.columns), F.lit(0))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def sized_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a settled table: broadcast up to a counted size, shuffled beyond it."""
    return df.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)
