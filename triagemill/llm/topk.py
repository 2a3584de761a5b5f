"""Exact top-k search by Fagin's threshold algorithm.

Rows are dealt into blocks of bounded size, and so are the queries; every block of rows meets every block of queries.
Within a block each dimension has a list of its rows, ordered by that component.  For a query the lists are read in
parallel, each from the end that its own component favours.  A row seen for the first time in any list gets its full
score by random access.  What the lists show at the current depth bounds the score of all rows not yet seen; reading
stops when this bound is below the k-th best score so far (equal scores may still win by a smaller id).  The best of the
blocks are merged by rank.

Components become ``floor(scale * x)``, whole numbers, so scores are exact.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as continued
with zeros; rows without id are no queries and come last among ties; repeated rows are candidates each, and every row
but the query's own id is one; equal rows are one query, and several vectors of one id are a query each, so that such an
id has every rank as often as it has vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.llm.common import ship
from triagemill.session import settle

ROWS, QUERIES, STEP = 8192, 1024, 64


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Whole numbers as float64 where all sums stay exact there, as int64 where they fit, as Python's otherwise."""
    most = max((max(map(abs, v), default=0) for v in vectors), default=0)
    kind = np.float64 if most * most * max(width, 1) < 1 << 53 else np.int64 if most * most * max(width, 1) < 1 << 62 else object
    out = np.zeros((len(vectors), width), kind)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


class SortedLists:
    """A block of rows with a list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")  # ascending; read from the other end for positive weights

    def search(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows with another id, ties to the smaller id."""
        n, used = len(self.rows), np.flatnonzero(query)
        best: list[tuple[int, int]] = []
        seen = np.zeros(n, bool)
        depth, step = 0, STEP
        while depth < n:
            to = min(n, depth + step)
            up = query[used] < 0
            lists = np.concatenate([self.order[depth:to, used[up]].ravel(), self.order[n - to:n - depth, used[~up]].ravel()])
            new = np.unique(lists[~seen[lists]]) if len(used) else np.arange(n)
            seen[new] = True
            if len(new):
                new = new[self.ids[new] != own]
                scores = self.rows[new] @ query
                keep = np.flatnonzero(scores >= best[-1][0]) if len(best) == k else np.arange(len(new))
                if len(keep) > 4 * k:  # all that reach the k-th score, ties included
                    cut = np.partition(scores[keep], len(keep) - k)[len(keep) - k] if scores.dtype != object else sorted(scores[keep])[-k]
                    keep = keep[scores[keep] >= cut]
                best = sorted(best + [(int(scores[i]), self.ids[new[i]]) for i in keep], key=_rank)[:k]
            if not len(used):
                break
            depth, step = to, step * 2
            # no unseen row can beat what the lists show where reading stopped
            edge = np.where(up, self.order[to - 1, used], self.order[n - to, used])
            bound = int((self.rows[edge, used] * query[used]).sum())
            if len(best) == k and best[-1][0] > bound:
                break
        return best


def _rank(x):
    return (-x[0], x[1] is None, x[1] or 0)


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding",
          rows_per_block: int = ROWS, queries_per_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by inner product for every id and vector that is a query."""
    spark = table.sparkSession
    ship(spark)
    x = F.col(vector)
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = settle(table.filter(sound).select(
        F.col(key).cast("bigint").alias("id"), whole(x, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    asking = settle(rows.filter("q and id is not null").select("id", "v").distinct().withColumn("n", F.monotonically_increasing_id()), "queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    blocks, askers = max(1, -(-size["n"] // rows_per_block)), max(1, -(-asking.count() // queries_per_block))
    width = size["w"] or 0
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # blocks by hash, so that no value of any column decides how full one is; every pair of blocks is one group
    block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.select("id", "v", block(blocks, 1).alias("rb"), each(askers).alias("qb"))
    right = asking.select("id", "v", "n", each(blocks).alias("rb"), block(askers, 2).alias("qb"))

    def meet(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and asked.num_rows:
            vectors = mine.column("v").to_pylist() + asked.column("v").to_pylist()
            both = _matrix(vectors, width)
            lists = SortedLists(np.array(mine.column("id").to_pylist(), object), both[:mine.num_rows])
            for n, q, row in zip(asked.column("n").to_pylist(), asked.column("id").to_pylist(), both[mine.num_rows:]):
                out += [(n, q, i, s) for s, i in lists.search(row, q, k)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["n", "query_id", "vec_id", "score"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, "n long, query_id long, vec_id long, score long")
    order = W.partitionBy("n").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(key), "score")
