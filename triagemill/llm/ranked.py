"""Ranked lexical search with range-maximum tables.

Documents become bags of the query terms they hold.  Each task reads its bags in shards of bounded size and lays out a
posting list per term, in the order of document ids, with a sparse table that gives the largest impact of any stretch.  A
query starts with the interval of all documents of the shard.  The interval with the highest bound (the sum of its
terms' maxima) is split at the document of the largest maximum, which is scored exactly; both rests get bounds of their
own.  Intervals that cannot beat the k-th result so far are dropped, also results of earlier shards of the task.  The
best of every task meet in one window.

Queries go out in blocks of counted rows and bytes; each block passes over all documents.

Cases: null texts and texts without terms take no part; documents of one id are ranked each by itself, with ids repeated;
equal query rows are one query, different texts of one item id are ranked each by itself; ties go to the smaller id, a
null id is the smallest; fewer than k results are fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.llm.common import ship
from triagemill.session import settle

# fixed values: bytes that part terms, and A-Z as a-z
_PART = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = bytes(0x20 if b in _PART else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# a block of queries, a shard of a task, and the cells of one query's working tables
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 8 * 1024 * 1024
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 65_536
CELLS = 4_000_000
STEP = 256  # intervals that are split together


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Shard:
    """Posting lists of some documents, laid end to end, with range-maximum tables."""

    def __init__(self, keys: list, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, docs: int, total: int):
        """``counts`` entries of ``ids`` and ``tfs`` belong to each document; ``docs`` and ``total`` are those of the corpus."""
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))
        self.keys = [keys[i] for i in order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        of = np.repeat(np.arange(len(keys)), counts)
        norm = 25 + (75 * sizes.astype(np.int64) * docs) // total
        impact = (1_000_000_000 * tfs.astype(np.int64)) // (1000 * tfs.astype(np.int64) + 8 * norm[of])
        at = place[of]
        lists = np.lexsort((at, ids))
        self.docs, self.impact = at[lists].astype(np.int32), impact[lists].astype(np.int32)
        sorted_ids = ids[lists]
        self.terms, first = np.unique(sorted_ids, return_index=True)
        self.first = np.append(first, len(sorted_ids))
        longest = int(np.diff(self.first).max(initial=1))
        self.table = [np.arange(len(sorted_ids), dtype=np.int32)]
        for level in range(longest.bit_length() - 1):
            low = self.table[-1]
            high = np.append(low[1 << level:], low[len(low) - min(1 << level, len(low)):])
            self.table.append(np.where(self.impact[high] > self.impact[low], high, low).astype(np.int32))
        self.table = np.stack(self.table)
        self.log = np.zeros(longest + 1, np.int8)
        for n in range(2, longest + 1):
            self.log[n] = self.log[n >> 1] + 1

    def search(self, wanted: np.ndarray, weights: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best, of those ``held`` already and those of this shard.

        ``wanted`` are sorted term ids, ``weights`` their weights times their occurrences in the query.
        """
        row = np.searchsorted(self.terms, wanted)
        there = (row < len(self.terms)) & (weights > 0)
        there[there] = self.terms[row[there]] == wanted[there]
        lists = [(self.first[r], self.first[r + 1]) for r in row[there]]
        if not lists:
            return held
        width = max(1, CELLS // len(lists))  # long queries go over the documents in stretches
        for a in range(0, len(self.keys), width):
            held = self._stretch(lists, weights[there][:, None], a, min(a + width, len(self.keys)), k, held)
        return held

    def _stretch(self, lists, weights, a: int, b: int, k: int, held):
        # rank[t, x]: first posting of term t at document a + x or behind
        rank = np.zeros((len(lists), b - a + 1), np.int32)
        for t, (i, j) in enumerate(lists):
            some = self.docs[i:j]
            lo, hi = (0, len(some)) if b - a == len(self.keys) else np.searchsorted(some, (a, b))
            rank[t, some[lo:hi] - a + 1] = 1
            rank[t, 0] = i + lo
        np.cumsum(rank, axis=1, out=rank)
        impact, docs, table, log = self.impact, self.docs, self.table, self.log

        def bounds(lo, hi):
            """Sum of the maxima of each interval, and the document of the largest."""
            i, j = rank[:, lo], rank[:, hi]
            n = j - i
            level = log[n]
            i = np.minimum(i, len(docs) - 1)
            one, two = table[level, i], table[level, np.maximum(j - (1 << level.astype(np.int32)), 0)]
            best = np.where(impact[two] > impact[one], two, one)
            value = np.where(n > 0, impact[best], 0) * weights
            top = best[np.argmax(value, axis=0), np.arange(len(lo))]
            return value.sum(axis=0), docs[top] - a

        score, place = held
        lo, hi = np.array([0]), np.array([b - a])
        bound, cut = bounds(lo, hi)
        step = 8
        while True:
            least, last = 1, np.inf  # the k-th result: what scores less, or equal and lies behind, cannot be one
            if len(score) == k:
                least, last = score[-1], place[-1]
            may = (bound > least) | ((bound == least) & (lo + a < last))
            bound, lo, hi, cut = bound[may], lo[may], hi[may], cut[may]
            if not len(bound):
                return score, place
            if len(bound) > step:
                take = np.argpartition(bound, -step)[-step:]
            else:
                take = np.arange(len(bound))
            d, left, right = cut[take], lo[take], hi[take]
            at = rank[:, d]
            exact = (np.where(rank[:, d + 1] > at, impact[np.minimum(at, len(docs) - 1)], 0) * weights).sum(axis=0)
            score, place = np.concatenate((score, exact[exact > 0])), np.concatenate((place, (d + a)[exact > 0]))
            best = np.lexsort((place, -score))[:k]
            score, place = score[best], place[best]
            new_lo, new_hi = np.concatenate((left, d + 1)), np.concatenate((d, right))
            some = new_lo < new_hi
            new_lo, new_hi = new_lo[some], new_hi[some]
            rest = np.ones(len(bound), bool)
            rest[take] = False
            new_bound, new_cut = bounds(new_lo, new_hi) if len(new_lo) else (bound[:0], cut[:0])
            bound, cut = np.concatenate((bound[rest], new_bound)), np.concatenate((cut[rest], new_cut))
            lo, hi = np.concatenate((lo[rest], new_lo)), np.concatenate((hi[rest], new_hi))
            step = min(STEP, step * 2)


class Ranking:
    """The k best documents of each query, over one shard after another."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[int, object]]] = [[] for _ in queries]

    def add(self, shard: Shard) -> None:
        from bisect import bisect_left

        order = [(x is not None, x) for x in shard.keys]
        for q, (wanted, weights) in enumerate(self.queries):
            held = self.best[q]
            # earlier results stand before the first document of this shard with their key or a larger one
            before = [bisect_left(order, (x is not None, x)) - 0.5 for _, x in held]
            n = np.arange(len(held)) / (len(held) + 1) / 4  # and keep their order
            score, place = shard.search(wanted, weights, self.k, (np.array([s for s, _ in held], np.int64), np.array(before) + n))
            old = {p: x for p, (_, x) in zip((np.array(before) + n).tolist(), held)}
            self.best[q] = [(s, old[p] if p in old else shard.keys[int(p)]) for s, p in zip(score.tolist(), place.tolist())]


def _bags(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``_key``, ``n`` (terms with repeats), ``ids`` and ``tfs`` of the vocabulary's terms; documents without terms are left out."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.get
        for b in batches:
            keep, sizes, ends, ids, tfs = [], [], [0], [], []
            for i, x in enumerate(b.column(1)):
                words = terms(x.as_py() or b"")
                if not words:
                    continue
                for w, n in Counter(words).items():
                    t = place(w)
                    if t is not None:
                        ids.append(t)
                        tfs.append(n)
                keep.append(i)
                sizes.append(len(words))
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["_key", "n", "ids", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, n long, ids array<int>, tfs array<int>")


def _block(docs: DataFrame, items: list, k: int, key: str, text: str, item: str, item_kind: str) -> DataFrame:
    """Results of one block of queries: (item id, Counter of terms) pairs."""
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*(c for _, c in items)))
    number = {w: i for i, w in enumerate(vocabulary)}
    bags = settle(_bags(docs, vocabulary, key, text), "bags")
    size = bags.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n, total = size["n"], size["l"] or 1
    # a row per term of the block's vocabulary
    held = dict(bags.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect())
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
    queries = []
    for _, c in items:
        got = sorted((number[w], weight[number[w]] * times) for w, times in c.items() if number[w] in weight)
        queries.append((np.array([t for t, _ in got], np.int32), np.array([w for _, w in got], np.int64)))
    sent = spark.sparkContext.broadcast(queries)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking, some, postings, rows = Ranking(sent.value, k), [], 0, 0
        arrow_key = None

        def full() -> Shard:
            join = lambda i: np.concatenate([x.column(i).flatten().to_numpy() for x in some])
            counts = np.concatenate([x.column(2).value_lengths().to_numpy() for x in some])
            return Shard([y for x in some for y in x.column(0).to_pylist()], np.concatenate([x.column(1).to_numpy() for x in some]),
                         counts, join(2), join(3), n, total)

        for batch in batches:
            arrow_key = batch.column(0).type
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                some.append(part)
                postings, rows = postings + len(part.column(2).flatten()), rows + part.num_rows
                if postings >= SHARD_POSTINGS or rows >= SHARD_DOCS:
                    ranking.add(full())
                    some, postings, rows = [], 0, 0
        if some:
            ranking.add(full())
        found = [(q, s, x) for q, best in enumerate(ranking.best) for s, x in best]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _, _ in found], pa.int32()), pa.array([s for _, s, _ in found], pa.int64()),
                 pa.array([x for _, _, x in found], arrow_key)], ["_q", "score", "_key"])

    ids = spark.createDataFrame([(q, x) for q, (x, _) in enumerate(items)], f"_n int, _item {item_kind}")
    ranked = bags.mapInArrow(run, f"_q int, score long, _key {kind}").withColumn(
        "rank", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), F.asc("_key")))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(ids), F.col("_q") == F.col("_n")).select(  # a block has at most BLOCK_ITEMS rows
        F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Item id, ``rank`` (from 1), document id and ``score`` of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    item_kind = items.schema[item].dataType.simpleString()
    rows = items.select(F.col(item).alias("_item"), F.col(item_text).cast("binary").alias("_text")).filter(F.length("_text") > 0).distinct()
    done, block, size = [], [], 0
    for r in settle(rows, "queries").toLocalIterator():  # the stated queries, one part at a time
        c = Counter(terms(bytes(r["_text"])))
        if not c:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(r["_text"]) > BLOCK_BYTES):
            done.append(settle(_block(docs, block, k, key, text, item, item_kind), "ranked"))
            block, size = [], 0
        block.append((r["_item"], c))
        size += len(r["_text"])
    if block:
        done.append(_block(docs, block, k, key, text, item, item_kind))
    if not done:
        kind = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{item}` {item_kind}, rank int, `{key}` {kind}, score long")
    return reduce(DataFrame.union, done)
