"""Secret scans by corpus-wide ownership frequency.

Candidates are the matches of the base patterns and long runs of token characters.  Their values are hashed and counted
over the whole corpus by distinct owners and distinct repositories of an owner.  A value of many owners or repositories is
a widely copied example; a value of one owner that looks like key material is taken for a live credential of that owner
and adds a span of kind ``owned``.  Base spans always stay.

Cases: a null or empty text has no spans; a null owner is one owner, a null document id one repository of its owner;
repeated documents give repeated rows and count once as a repository; spans of different kinds may overlap, one place is
``owned`` once; texts are never cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.session import settle

# fixed values: kinds in the order in which spans of one place are listed, and their patterns
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 12
# a value of so many owners, or in so many repositories, is a copied example
WIDE_OWNERS, WIDE_REPOS = 3, 20
# a live-looking value has a letter, a digit, and at least so many characters and distinct characters
LIVE_LENGTH, LIVE_DISTINCT = 16, 8
BLOCK = 256  # spans that are placed together; places of a text then cost little more than their number


def _placed(steps: Column) -> Column:
    """Running places of array<struct<gap, size, value>>, block by block."""
    blocks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(BLOCK)), lambda b: F.slice(steps, b + 1, F.lit(BLOCK)))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(s, x):
        start = s["till"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("till"), F.concat(s["done"], F.array(span)).alias("done"))

    zero = F.struct(F.lit(0).alias("till"), F.array().cast(kind).alias("done"))
    own = F.transform(blocks, lambda xs: F.aggregate(xs, zero, step))
    start = F.struct(F.lit(0).alias("till"), F.array().cast("array<int>").alias("bases"))
    bases = F.aggregate(own, start, lambda s, x: F.struct(
        (s["till"] + x["till"]).alias("till"), F.concat(s["bases"], F.array(s["till"])).alias("bases")), lambda s: s["bases"])
    moved = F.zip_with(own, bases, lambda b, base: F.transform(b["done"], lambda x: F.struct(
        (x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["value"].alias("value"))))
    return F.when(F.size(steps) > 0, F.flatten(moved)).otherwise(F.array().cast(kind))


def _spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """Places (code points) of all matches with their values: the match or one of its groups."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(
        gap.alias("gap"), F.char_length(m).alias("size"), value(m).alias("value")))
    # most texts have no match: they are passed over once
    return F.when(F.regexp_like(text, F.lit(pattern)), _placed(steps)).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _live(value: Column) -> Column:
    return ((F.char_length(value) >= LIVE_LENGTH) & F.regexp_like(value, F.lit("[A-Za-z]")) & F.regexp_like(value, F.lit("[0-9]"))
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """``_id``, ``_key`` (hash of the text), ``_owner`` and ``_spans`` of every row; values appear as hashes only."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), F.col(owner).alias("_owner"), F.xxhash64(whole).alias("_key"), whole.alias("_text"))
    kinds = [(ASSIGN, 2), (ACCESS, None), (HEX, None), (RUN, None)]
    rows = rows.select("_id", "_owner", "_key", *[_spans(F.col("_text"), p, g).alias(f"_{i}") for i, (p, g) in enumerate(kinds)])

    def told(x: Column, rank: int) -> Column:
        return F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
            (x["end"] - F.char_length(x["value"])).alias("begin"), F.sha2(x["value"], 256).alias("hash"), _live(x["value"]).alias("live"))

    def all_told(column, rank: int) -> Column:
        return F.transform(column, lambda x: told(x, rank))

    parts = [all_told(F.filter("_0", lambda x: F.char_length(x["value"]) >= ASSIGN_LEAST), 0)]
    parts += [all_told(f"_{i}", i) for i in (1, 2, 3)]
    return rows.select("_id", "_owner", "_key", F.concat(*parts).alias("_spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``owners`` and ``repos`` (owner and document id) of every candidate value, aggregated in three steps so
    that a value of a third of all rows is merged before each shuffle."""
    held = found.select("_owner", "_id", F.explode("_spans.hash").alias("hash")).distinct()
    by_owner = held.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source",
                 wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """One row per document: its id, ``text_key`` and ``spans`` (start, kind as a place in ``KINDS``, end, ``verdict`` of
    the value, its ``owners`` and ``repos``), sorted.  The verdict is copied, owned or unclear."""
    found = settle(candidates(docs, key, text, owner), "candidates")
    values = settle(ownership(found), "ownership")
    copied = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    verdict = F.when(copied, "copied").when((F.col("owners") == 1) & F.col("x.live"), "owned").otherwise("unclear")
    told = found.select("_id", "_key", F.explode("_spans").alias("x"), F.col("x.hash").alias("hash")).join(values, "hash")
    told = told.withColumn("verdict", verdict)

    def span(start: str, rank: Column) -> Column:
        return F.struct(F.col(start).alias("start"), rank.alias("rank"), F.col("x.end").alias("end"), "verdict", "owners", "repos")

    base = F.when(F.col("x.rank") < 3, span("x.start", F.col("x.rank")))
    added = F.when(F.col("verdict") == "owned", span("x.begin", F.lit(3)))
    kept = told.select("_id", "_key", F.explode(F.array(base, added)).alias("span")).filter(F.col("span").isNotNull())
    kept = kept.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    kept = kept.withColumnsRenamed({"_id": "_doc", "_key": "_text"})
    rows = found.select("_id", "_key").join(kept, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left")
    kind = kept.schema["spans"].dataType.simpleString()
    return rows.select(F.col("_id").alias(key), F.col("_key").alias("text_key"), F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["rank"] == KINDS.index(kind)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["start"], x["end"])), ",")
