"""Small helpers that several operators of this package share."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.session import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# a settled side may be broadcast up to these counted sizes; beyond them the join is shuffled
SEND_ROWS = 200_000
SEND_BYTES = 8 * 1024 * 1024


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of one byte per character take the quick built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def listed_ranges(pattern: str) -> str:
    r"""The same pattern with each range ``\xHH-\xHH`` spelt out: Java looks single characters up in a table, but tries ranges in turn."""
    spelt = lambda m: "".join(f"\\x{c:02X}" for c in range(int(m[1], 16), int(m[2], 16) + 1))
    return re.sub(r"\\x([0-9A-Fa-f]{2})-\\x([0-9A-Fa-f]{2})", spelt, pattern)


def words_of(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(listed_ranges(pattern)), F.lit(0)), F.array().cast("array<string>"))


def free_prefix(columns: list[str]) -> str:
    """A beginning that none of the names has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def can_send(table: DataFrame) -> bool:
    """Whether a settled table is small enough, in counted rows and bytes, to go to every executor."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(4)) for c in table.columns), F.lit(0))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return size["n"] <= SEND_ROWS and size["b"] <= SEND_BYTES


def sent(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its counted size allows that."""
    return F.broadcast(table) if can_send(table) else table


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query run meanwhile when that query ends, not at some later collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, for the operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="triagemill-code-")) / "triagemill.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def numbered(table: DataFrame, *order: Column) -> DataFrame:
    """The table with ``number`` (from 0) by ``order``: rows are dealt by range and each part is counted on."""
    dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = settle(dealt.withColumn("_part", F.spark_partition_id()), "numbered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    base = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(sent(settle(base, "parts")), "_part").withColumn("number", F.col("_base") + place).drop("_part", "_base")
