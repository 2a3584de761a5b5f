"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are the distinct n-gram sets, columns the n-grams.  Two rows with Jaccard similarity of at least
``num / den`` differ in at most ``H = (nx + ny) (den - num) / (den + num)`` columns, so of more than H column blocks
some must be equal in both rows.  The steps:

1. Equal sets become one row (a node).  Column blocks are made per size band (H follows from the band's largest size);
   a row gives the hash of its content in each block.  There are more than H + 1 blocks: a row may leave out its emptiest
   ones, and a row that shares fewer blocks than a link must leave equal is done, it has no link.
2. Rows that are equal in some block meet.  In a small block all pairs do, less those that share too few blocks.  In a
   large one they do not: its rows are multiplied with one hub, a row that shares much, and the same one for most
   blocks of rows that are much alike.  A link whose blocks are all large gives both rows as many large blocks as a link
   must share, so rows with fewer have no hub, and the others need not meet the hub of every block.  The product gives
   the overlap count of every row with its hubs, and exact links.
3. Two rows of a large block that are not yet in one component have both been compared with the block's hub.  Their overlap
   follows from what each has more or less than the hub: ``|x ^ y| = |x ^ hub| + |y ^ hub| - 2 common``.  So the same
   product is formed of the differences, rarest columns first, and a pair is discarded unless it can reach the number
   of common differences that the sizes ask for.  The pairs left are multiplied exactly.

Nothing is capped: a block with thousands of rows costs a product with its hub for each, and pairs are only formed where
differences coincide.  Components come from rounds of star contraction.  N-grams and whole sets are told
apart by 64-bit hashes.

Cases: null or wordless texts have an empty set and are linked with nothing; a text with fewer words than ``n`` is one
sequence; ties do not occur (components take the smallest id); repeated rows are kept; rows without id take part and get
the smallest id of their component, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagemill.llm.common import sent, ship, shuffles_freed
from triagemill.session import collecting, drop_scratch, settle

N, NUM, DEN = 3, 90, 100
SMALL = 6  # rows of a block whose pairs are all formed; larger blocks have a hub
TAG = 8  # bits of a band in a row's tag; what it needs stands above them
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Scatter 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def ngrams(text: bytes, n: int = N) -> np.ndarray:
    """Sorted hashes of a text's distinct n-grams; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    grams = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        grams = _mix(grams + h[i:len(h) - size + 1 + i], i + 1)
    return np.unique(grams)


class Bands:
    """Size bands and the number of column blocks in each."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]
        # blocks with fewer n-grams than this say little (a share of what a block holds on average in small sets)
        self.small = max(1, (den + num) * 20 // ((den - num) * 115)) if den > num else 1
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 5 // 4)))

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band, blocks, spare blocks) of the bands in which a set of ``n`` can meet one of its size or larger."""
        band = bisect_right(self.low, n) - 1
        while self.num * max(n, self.low[band]) <= self.den * n:
            most = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            if most:  # otherwise only equal sets are linked
                spare = 1 + most // 4
                yield band, most + 1 + spare, spare
            band += 1


def block_keys(grams: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """Per band, how many blocks a linked row must share, and the hashes of the row's content in its blocks."""
    keys = []
    if len(grams):
        content = _mix(grams, 77)
        for band, blocks, spare in bands.of(len(grams)):
            place = ((_mix(grams, 1000 + band) >> _U(32)) * _U(blocks)) >> _U(32)
            order = np.argsort(place, kind="stable")
            count = np.bincount(place.astype(np.int64), minlength=blocks)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(content[order], dtype=np.uint64)])
            ends = np.cumsum(count)
            sums = total[ends] - total[ends - count]
            key = _mix(sums + _U(band << 32) + np.arange(blocks, dtype=np.uint64), 99)
            large = count >= bands.small
            gone = blocks - int(large.sum())
            # small blocks that are equal are small in both rows; a row that keeps its small ones may meet one that does not
            keys.append((1 + spare - gone, key[large]) if gone <= spare else (1, key))
    return keys


def _digest(grams: np.ndarray) -> int:
    """64 bits of a set, whatever its order; it names the node."""
    return int(_mix(_mix(grams, 5).sum(dtype=np.uint64, keepdims=True) + _U(len(grams)), 6).view(np.int64)[0])


def _digests(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, size and digest of the set of every row."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                grams = [ngrams(t or b"", n) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(map(len, grams), pa.int64()), pa.array(map(_digest, grams), pa.int64())],
                    ["doc_id", "text_key", "n", "node"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, node long")


def _blocks(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, tag (what it needs, then the place among the node's bands) and the block keys of documents.

    Made anew where it is used: the keys are many, and cheaper to make than to keep.
    """
    bands = Bands(num, den)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for text in b.slice(i, 256).column(2).to_pylist():
                    g = ngrams(text or b"", n)
                    rows += [(_digest(g), need << TAG | band, k.view(np.int64)) for band, (need, k) in enumerate(block_keys(g, bands))]
                cols = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["node", "tag", "keys"])

    return docs.mapInArrow(run, "node long, tag long, keys array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Node, size and sorted n-gram hashes (bytes) of documents."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                grams = [ngrams(t or b"", n) for t in b.slice(i, 512).column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(_digest, grams), pa.int64()), pa.array(map(len, grams), pa.int64()),
                    pa.array([g.tobytes() for g in grams], pa.binary())], ["node", "n", "grams"])

    return docs.mapInArrow(run, "node long, n long, grams binary")


def _multiplied(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes and overlap counts of node pairs (a, b), and the columns in which they differ where ``wide`` asks for them."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                a, b, wide, x, y = (c.to_pylist() for c in batch.slice(i, 256).columns)
                common, differ = [], []
                na, nb = ([len(v) // 8 for v in side] for side in (x, y))
                for p, q, w in zip(x, y, wide):
                    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                    at = np.searchsorted(q, p)
                    both = at < len(q)
                    both[both] = q[at[both]] == p[both]
                    common.append(int(both.sum()))
                    gone = np.ones(len(q), bool)
                    gone[at[both]] = False
                    differ.append(np.concatenate([p[~both], q[gone]]).view(np.int64) if w else None)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v, pa.int64()) for v in (a, b, na, nb, common)), pa.array(differ, pa.list_(pa.int64()))],
                    ["a", "b", "na", "nb", "common", "differ"])

    rows = pairs.select("a", "b", "wide").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "wide", "x", "y")
    return rows.mapInArrow(run, "a long, b long, na long, nb long, common long, differ array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node of its component) of all nodes of the edges, by alternating star contractions."""
    edges = settle(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    last = mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # each node's larger neighbours are tied to its smallest one, then each node's smaller ones are
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = settle(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)


def _pairs(blocks: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes (a, b) that are equal in some block; ``wide`` where b is the hub of a large block of a's.

    A link shares ``need`` blocks.  If one of them is small, its pairs have the link; if none is, both rows have ``need``
    large blocks, and rows with fewer stay away from the hubs.
    """
    others = F.count(F.lit(1)).over(W.partitionBy("key"))
    # the keys go through one shuffle: a row stays if another row has its key, and shares as many as a link asks for
    cells = blocks.select(F.explode("keys").alias("key"), "node", "tag").withColumn("c", others)
    met = settle(cells.filter("c > 1").drop("c").distinct(), "met")
    need = F.shiftright("tag", TAG)
    row = W.partitionBy("node", "tag")
    met = met.withColumn("s", F.count(F.lit(1)).over(row)).filter(F.col("s") >= need).select("key", "node", "tag")
    met = settle(met.withColumn("c", others).filter("c > 1"), "kept")
    met = settle(met.withColumn("large", F.count(F.when(F.col("c") > SMALL, 1)).over(row)), "ranked")
    # small blocks: all pairs, less those that share too few, whatever large blocks they share
    rows = met.filter(F.col("c") <= SMALL).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("node", "tag", need.alias("need"), "large"))).alias("rows"))
    rows = rows.select("rows", F.posexplode("rows").alias("i", "x")).select("x", F.explode(F.slice("rows", F.col("i") + 2, SMALL)).alias("y"))
    close = rows.groupBy(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.tag").alias("tag_a"), F.col("y.tag").alias("tag_b")).agg(
        (F.count(F.lit(1)) + F.first(F.least("x.large", "y.large")) - F.first(F.greatest("x.need", "y.need"))).alias("over"))
    close = close.filter("over >= 0 and a <> b").select("a", "b", F.lit(False).alias("wide"))
    # large blocks: each one's hub is the best that most of its rows have in some block, so that few rows meet several hubs
    met = settle(met.filter((F.col("c") > SMALL) & (F.col("large") >= need)).select("key", "node", "tag", "c", "large"), "large")
    score = met.groupBy("node").agg(F.sum("c").alias("score"))
    top = met.join(score, "node").groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("rest"))).alias("top"))
    best = met.join(top, "key").groupBy("node").agg(F.max("top").alias("top"))
    votes = met.join(best, "node").groupBy("key", "top").agg(F.count(F.lit(1)).alias("votes"))
    hub = votes.groupBy("key").agg(F.max(F.struct("votes", "top")).alias("hub")).select("key", F.col("hub.top").alias("top"))
    # of a row's large blocks, the need - 1 with the least hubs go: in one order for all rows, the first block that two
    # linked rows share has need - 1 shared ones behind it in both, so it stays in both
    place = F.row_number().over(row.orderBy(F.desc("top"), "key"))
    far = met.join(hub, "key").withColumn("place", place).filter(F.col("place") <= F.col("large") - need + 1)
    far = far.select(F.col("node").alias("a"), (-F.col("top.rest")).alias("b"), F.lit(True).alias("wide")).filter("a <> b")
    pairs = close.unionAll(far).groupBy("a", "b").agg(F.max("wide").alias("wide"))
    pairs = _sized(pairs, nodes).filter(F.col("wide") | (
        (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)))
    return pairs.select("a", "b", "wide")


def _links(alone: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the nodes' components; ``alone`` has one document of each node."""
    used: list[str] = []
    with collecting(used):
        pairs = _pairs(_blocks(alone, n, num, den), nodes, num, den)
    pairs = settle(pairs, "pairs")
    drop_scratch(alone.sparkSession, used)
    # full sets of the nodes that met another
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node")
    wanted = sent(settle(wanted.select(F.col("from.doc_id").alias("w_id"), F.col("from.text_key").alias("w_key")), "wanted"))
    sets = settle(_sets(alone.join(wanted, _same(wanted), "left_semi"), n).dropDuplicates(["node"]), "sets")
    done = settle(_multiplied(pairs, sets), "products")
    close = (F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num)
    links = done.filter(close).select("a", "b")
    root = settle(components(links), "roots")
    more = settle(_by_differences(done, root, num, den), "candidates")
    found = settle(_multiplied(more.withColumn("wide", F.lit(False)), sets).filter(close).select("a", "b"), "links")
    return links.unionAll(found)


def _same(t: DataFrame) -> Column:
    return F.col("doc_id").eqNullSafe(t["w_id"]) & (F.col("text_key") == t["w_key"])


def jaccard_join(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_key (hash of the text), n_shingles, component_id and group of every row.

    Rows are linked from a similarity of ``num / den`` on; ``group`` numbers the components (null for empty sets).
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("binary").alias("t"))
    rows = settle(_digests(source, n), "digests")
    nodes = settle(rows.filter("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("from")), "nodes")
    # one document speaks for a node
    copies = rows.join(nodes.select("node", "from"), "node").filter(F.struct("doc_id", "text_key") != F.col("from"))
    copies = sent(settle(copies.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).distinct(), "copies"))
    alone = source.join(copies, _same(copies), "left_anti")
    used: list[str] = []
    with shuffles_freed(spark):
        with collecting(used):
            links = _links(alone, nodes, n, num, den)
        root = settle(components(links), "roots")
    drop_scratch(spark, used)
    # the smallest document id of each component
    labelled = nodes.select("node", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(smallest, "root").select("node", "component_id", F.col("root").alias("group"))
    out = rows.join(labelled, "node", "left")
    return out.select(
        F.col("doc_id").alias(key), "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def keep_one(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but one of each group: the one with the smallest id stays (without ids, the one with the
    smallest hash of its text).  Rows with an empty set stay."""
    pair = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("text_key").alias("h"))
    rows = settle(groups.filter(F.col("group").isNotNull()).groupBy("group", pair.alias("p")).agg(F.count(F.lit(1)).alias("times")), "groups")
    best = rows.groupBy("group").agg(F.min("p").alias("best"), F.sum("times").alias("all")).filter("all > 1")
    met = settle(rows.join(best, "group").select("p.id", "p.h", (F.col("p") == F.col("best")).alias("stays"), "times"), "copies")
    # the documents travel in one column, so that no name of theirs meets one used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    marked = docs.select(whole, F.col(key).alias("own"), F.xxhash64(F.col(text)).alias("own_h"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h"))
    gone = sent(settle(met.filter("not stays").select("id", "h").distinct(), "gone"))
    left = marked.join(gone, same, "left_anti")
    again = settle(met.filter("stays and times > 1").select("id", "h"), "again")
    if again.take(1):  # the document that stays is there in several rows
        again = sent(again)
        one = left.join(again, same, "left_semi").dropDuplicates(["own", "own_h"])
        left = left.join(again, same, "left_anti").unionByName(one)
    return left.select("doc.*")


def _sized(products: DataFrame, size: DataFrame) -> DataFrame:
    return products.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(
        size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")


def _by_differences(done: DataFrame, root: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) in different components, compared with one hub, that may yet be linked."""
    named = done.filter(F.col("differ").isNotNull()).select(F.col("b").alias("hub"), F.col("a").alias("x"), F.col("na").alias("n"), "differ").join(
        root.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    open_hubs = named.groupBy("hub").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("hub")
    named = settle(named.join(sent(settle(open_hubs, "open_hubs")), "hub", "left_semi"), "open")
    cells = named.select("hub", "x", F.explode("differ").alias("col")).withColumn("cell", F.xxhash64("hub", "col"))
    # counted by hash: where two cells share one, both have the larger count, which keeps the order sound
    often = cells.withColumn("often", F.count(F.lit(1)).over(W.partitionBy("cell"))).filter("often > 1")
    # columns that one row alone has come first and match nothing; then the rarest of the others
    rare = often.groupBy("hub", "x").agg(F.array_sort(F.collect_list(F.struct("often", "col"))).alias("cols"))
    front = named.select("hub", "x", "n", "root", F.size("differ").alias("d")).join(rare, ["hub", "x"]).select(
        "hub", "x", "n", "root", "d", F.posexplode("cols").alias("i", "c"), (F.col("d") - F.size("cols")).alias("alone"))
    most = lambda m: F.floor((F.col("n") + m) * (den - num) / F.lit(den + num))  # noqa: E731  most differences of a link
    widest = most(F.floor(F.col("n") * den / F.lit(num)))
    front = front.select("hub", "x", "n", "root", "d", F.col("c.col").alias("col"), (F.col("alone") + F.col("i")).alias("i")).filter(
        F.col("i") <= widest)
    front = settle(front, "fronts")
    names = ("hub", "col", "x", "n", "root", "d", "i")
    left = front.select(*[F.col(c).alias(f"{c}_1") for c in names])
    right = front.withColumn("half", F.floor(widest / 2)).filter("i <= half").select(
        *[F.col(c).alias(f"{c}_2") for c in names])
    h = F.expr(f"((n_1 + n_2) * {den - num}) div {den + num}")
    fits = (
        ((F.col("d_1") > F.col("d_2")) | ((F.col("d_1") == F.col("d_2")) & (F.col("x_1") > F.col("x_2"))))
        & (F.col("root_1") != F.col("root_2"))
        & (F.col("n_1") * num <= F.col("n_2") * den) & (F.col("n_2") * num <= F.col("n_1") * den)
        & (F.col("i_1") * 2 <= F.col("d_1") - F.col("d_2") + h) & (F.col("i_2") * 2 <= F.col("d_2") - F.col("d_1") + h))
    met = left.join(right, (F.col("hub_1") == F.col("hub_2")) & (F.col("col_1") == F.col("col_2")) & fits)
    return met.select(F.col("x_1").alias("a"), F.col("x_2").alias("b")).distinct()
