"""Spelling variants by PartEnum signatures.

Words one edit apart have letter multisets whose binary vectors (one place for each letter and each of its occurrences)
differ in at most two places.  The places are dealt to four parts; two of the parts must then be equal, so a signature
names two parts and their letters.  One edit also leaves one half of the word as it is: a signature further names the
length of the shorter word and one half, which keeps words with equal letters apart.  Equal signatures meet in an
equi-join, the edit distance verifies each meeting.

Words are counted over all texts with partial sums.  A word follows the near word that occurs most, at least ``ratio``
times as often as itself; occurrences at least double with each step, so roots are found by pointer doubling in a few
joins.

Cases: a null or empty text has no words; a null document id reads as an empty string; each row counts, also where rows
repeat; ties go to the smallest word in code-point order; a table without words gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.common import lower_ascii, words_of
from triagemill.session import settle

# fixed values: characters of a word, and the rule by which one run in a number of runs loses a character
LETTERS = r"[A-Za-zÀ-ÿ]"
DROP_ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
PARTS, KEPT = 4, 2  # parts of the letter places, and how many of them are equal at a distance of PARTS - KEPT


def dropped(run: Column, key: Column) -> Column:
    """The run, without one character where the checksum of document and run says so."""
    check = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (check % F.char_length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(check % DROP_ONE_IN == 0, short).otherwise(run)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""
    # shorter runs cannot become words
    runs = words_of(lower_ascii(F.col(text)), LETTERS + "{%d,}" % LEAST_LENGTH)
    rows = docs.select(F.col(key).alias("_id"), F.explode(runs).alias("_run"))
    words = rows.groupBy(dropped(F.col("_run"), F.col("_id")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _parts(word: Column) -> Column:
    """The letters of a word with the numbers of their occurrences, by part."""
    letters = F.array_sort(F.split(word, ""))
    places = F.transform(letters, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(letters, c) + 1).cast("int").alias("o")))

    def part(p: int) -> Column:
        own = F.filter(places, lambda x: (F.ascii(x["c"]) + x["o"]) % PARTS == p)
        return F.concat_ws(" ", F.transform(own, lambda x: F.concat(x["c"], x["o"])))

    return F.array(*[part(p) for p in range(PARTS)])


def signatures(words: DataFrame) -> DataFrame:
    """``word``, ``sig`` and ``longer`` (whether it takes the part of the longer word there)."""
    rows = words.select("word", F.char_length("word").alias("_l"), _parts(F.col("word")).alias("_parts"))
    out = []
    for longer in (0, 1):
        least = F.col("_l") - longer
        head = least.cast("int") - F.ceil(least / 2).cast("int")
        halves = (F.substring("word", F.lit(1), head), F.substring("word", F.col("_l") - (least - head) + 1, F.col("_l")))
        for s, some in enumerate(combinations(range(PARTS), KEPT)):
            for side, half in enumerate(halves):
                sig = F.xxhash64(F.lit(2 * s + side), least, half, *[F.get("_parts", F.lit(p)) for p in some])
                out.append(F.struct(sig.alias("sig"), F.lit(bool(longer)).alias("longer")))
    return rows.select("word", F.explode(F.array(*out)).alias("_s")).select("word", "_s.sig", "_s.longer")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a`` and ``b`` one edit apart, each pair once in either order."""
    sigs = signatures(words)
    left = sigs.filter(~F.col("longer")).select("sig", F.col("word").alias("a"))
    right = sigs.select(F.col("sig").alias("_sig"), F.col("word").alias("b"), "longer")
    meets = (F.col("sig") == F.col("_sig")) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    pairs = left.join(right, meets).select("a", "b").distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p")).select("_p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words with a form: each round doubles the steps behind every word."""
    links = settle(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        links = settle(links.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "links")
        if links.filter("_moved").isEmpty():
            return links.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word."""
    if ratio < 2:
        raise ValueError("forms end only if each occurs at least twice as often")
    words = settle(count_words(docs, key, text), "words")
    other = words.select(F.col("word").alias("b"), F.col("n").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col("b").alias("form")))
    near = near_pairs(words).join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    rows = words.join(near, F.col("word") == F.col("a"), "left")
    takes = -F.col("_best.m") >= ratio * F.col("n")
    rows = settle(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("_best.form")).alias("form"), F.when(takes, -F.col("_best.m")).alias("form_n")), "variants")
    roots = _roots(rows.filter(F.col("form").isNotNull())).withColumnRenamed("word", "_word")
    return rows.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
