"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-word hashes the smallest is kept as a fingerprint.  A span of ``k + w - 1`` words that a
document shares with an item therefore holds a fingerprint that both sides keep; ``w`` is an item's own, so that a short
item does not widen what longer ones keep.  The fingerprints are joined, each
meeting is compared word by word and extended to both sides, and runs of at least the wanted span become hits.

Cases: a null or empty text has no words and no hits; an item with fewer words than the span counts as a whole; a null
item id marks words but is not listed; repeated documents give repeated rows; repeated items count once; an empty table
gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.common import can_send, lower_ascii, sent, words_of
from triagemill.session import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 5


def _grams(k: int) -> Column:
    """Hash of the k words from each place on; null where fewer follow."""

    def one(x, i):
        rest = [F.get("_words", i + j) for j in range(1, k)]
        return F.when(i + k <= F.size("_words"), F.xxhash64(x, *rest))

    return F.transform("_words", one)


def _run(step: int, most: int) -> Column:
    """How many hashes next to the current one, in direction ``step``, are not smaller than it."""
    found = None
    for d in range(1, most + 1):
        stop = ~F.coalesce(F.get("_grams", F.col("_at") + step * d) >= F.col("_hash"), F.lit(False))
        found = F.when(stop, F.lit(d - 1)) if found is None else found.when(stop, F.lit(d - 1))
    return F.lit(0) if found is None else found.otherwise(F.lit(most))


def fingerprints(words: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """Rows with ``_at``, ``_hash`` and ``_free`` of every hash that some window of ``least`` places keeps.

    ``_free`` counts the hashes around it, up to ``most - 1`` to either side, that are not smaller: a window of ``w``
    places keeps the hash if ``_free >= w - 1``.
    """
    rows = words.withColumn("_grams", _grams(k))
    # outer: else Spark infers a filter on the array's size, and makes the words anew to evaluate it
    rows = rows.select("*", F.posexplode_outer("_grams").alias("_at", "_hash"))
    rows = rows.withColumn("_free", _run(-1, most - 1) + _run(1, most - 1))
    keep = F.col("_hash").isNotNull() & (F.col("_free") >= least - 1)
    return rows.filter(keep).drop("_grams")


def _around(side: str, k: int, reach: int) -> list[Column]:
    """The words of a fingerprint and those before (nearest first) and after it."""
    at, words = F.col("_at"), F.col("_words")
    first = F.greatest(at - reach, F.lit(0))
    return [
        F.slice(words, at + 1, F.lit(k)).alias(f"{side}_gram"),
        F.reverse(F.slice(words, first + 1, at - first)).alias(f"{side}_left"),
        F.slice(words, at + k + 1, F.lit(reach)).alias(f"{side}_right"),
    ]


def _alike(part: str, reach: int) -> Column:
    """Length of the common beginning of the two sides' ``part``."""
    found = None
    for d in range(reach):
        stop = ~F.coalesce(F.get(f"d_{part}", F.lit(d)) == F.get(f"i_{part}", F.lit(d)), F.lit(False))
        found = F.when(stop, F.lit(d)) if found is None else found.when(stop, F.lit(d))
    return F.lit(0) if found is None else found.otherwise(F.lit(reach))


def _extended(k: int, reach: int) -> list[Column]:
    left, right = _alike("left", reach), _alike("right", reach)
    whole = (F.col("d_gram") == F.col("i_gram")) & (left + k + right >= F.col("_need"))
    span = F.when(whole, F.struct((F.col("_at") - left).alias("start"), (F.col("_at") + k + right).alias("end")))
    return [span.alias("_span"), F.when(whole, F.col("_item")).alias("_item")]


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, pattern: str = WORD,
                  doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``text_key`` (hash of the text), ``n_words``, merged hit ``spans`` (word places,
    end excluded), ``n_hit`` (words in them) and ``items`` (ids as strings, sorted)."""
    def texts(table, key):
        # the hash may be null by type, as it is in a table read back: joins of both then share one partitioning
        hashed = F.nullif(F.xxhash64(F.col(text)), F.lit(None).cast("bigint"))
        return table.select(F.struct(F.col(key).alias("id"), hashed.alias("key")).alias("_pair"), F.col(text).alias("_text"))

    def words(table):
        return table.select("_pair", words_of(lower_ascii(F.col("_text")), pattern).alias("_words"))

    bench = settle(
        words(texts(items, item_id)).filter(F.size("_words") > 0).distinct()
        .withColumn("_need", F.least(F.size("_words"), F.lit(span))), "items")
    needs = [r[0] for r in bench.select("_need").distinct().collect()]  # at most `span` values
    # a class of fingerprints per hash length, with its narrowest and widest window; each item keeps to its own window
    classes = {n: (1, 1) for n in needs if n < gram}
    wide = [n - gram + 1 for n in needs if n >= gram] or [span - gram + 1]
    classes[gram] = min(wide), max(wide)
    reach = span - 1
    grams = {}
    for k, (least, most) in classes.items():
        own = bench.filter(F.col("_need") >= gram if k == gram else F.col("_need") == k)
        kept = fingerprints(own, k, least, most).withColumn("_least", F.col("_need") - k).filter("_free >= _least")
        grams[k] = settle(kept.select(
            "_hash", F.col("_pair.id").cast("string").alias("_item"), "_need", "_least", *_around("i", k, reach)), "prints")
    source = texts(docs, doc_id)
    # narrow hashes meet the items' first: with the words beside them, the code that every hash passes is longer than Java
    # compiles; only documents with a common hash are read again for their words
    met = {}
    for k, (least, most) in classes.items():
        known = grams[k].select("_hash").distinct()
        prints = fingerprints(words(source), k, least, most).select("_pair", "_at", "_hash", "_free")
        prints = settle(prints.join(F.broadcast(known) if can_send(known) else known, "_hash", "left_semi"), "common")
        met[k] = settle(prints.join(grams[k], "_hash").filter("_free >= _least").drop("_hash", "_free", "_least"), "met")
    wanted = sent(settle(reduce(DataFrame.union, [m.select("_pair") for m in met.values()]).distinct(), "wanted"))
    # texts, not words, go through the shuffle, each once
    again = words(source.join(wanted, "_pair", "left_semi").dropDuplicates(["_pair"]))
    parts = []
    for k, m in met.items():
        both = m.join(again, "_pair").select("_pair", "_item", "_at", "_need", "i_gram", "i_left", "i_right", *_around("d", k, reach))
        parts.append(both.select("_pair", *_extended(k, reach)).filter(F.col("_span").isNotNull()))
    found = reduce(DataFrame.union, parts).groupBy("_pair").agg(
        F.collect_set("_span").alias("_spans"), F.collect_set("_item").alias("_items"))
    rows = words(source).select("_pair", F.size("_words").alias("_n")).join(found, "_pair", "left")
    spans = F.array_sort(F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")))
    rows = rows.withColumn("spans", _merged(spans))
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return rows.select(
        F.col("_pair.id").alias(doc_id), F.col("_pair.key").alias("text_key"), F.col("_n").cast("bigint").alias("n_words"),
        length.alias("n_hit"), F.array_sort(F.coalesce("_items", F.array().cast("array<string>"))).alias("items"), "spans")


def _merged(spans: Column) -> Column:
    """Disjoint spans with the same union; the part of each sorted span that lies behind all earlier ones."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("till"), F.array().cast(kind).alias("done"))

    def step(s, x):
        fresh = F.struct(F.greatest(x["start"], s["till"]).alias("start"), x["end"].alias("end"))
        return F.struct(
            F.greatest(s["till"], x["end"]).alias("till"),
            F.when(x["end"] > s["till"], F.concat(s["done"], F.array(fresh))).otherwise(s["done"]).alias("done"))

    return F.aggregate(spans, zero, step, lambda s: s["done"])


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """A document is contaminated when at least one word in ``share`` lies in a hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)
