"""Random forests whose large nodes are split by all tasks together and whose smaller ones are finished one node a task.

A level-by-level fit sends a histogram per node and partition; in deep trees there are more nodes than rows they hold.
Here only nodes with more than ``LOCAL`` drawn rows are split that way, a few levels of a large table.  Then the rows of
each node left are brought together and its subtree is grown where they are.  Trees never meet on the driver:
they are rows of a table, and blocks of them meet chunks of the rows to be scored.

Like MLlib's: 32 bins a feature, Poisson bootstrap, a random subset of features per node, Gini gain, votes by class shares.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.session import settle

BINS = 32
LOCAL = 8_000_000  # drawn rows of a node that one task may finish (some 50 bytes each while it does)
CHUNK = 200_000  # rows dealt to nodes at a time
SCORED = 2_000_000  # rows scored at a time: all trees are sent to each such chunk
BLOCK = 10  # trees that score a chunk in one task
ROWS = 1 << 16  # rows worked on at a time, so that they stay in a core's cache
NODES = 1024  # nodes whose histograms are made at a time
_CDF = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, i + 1))) for i in range(16)])  # Poisson(1)
_U = np.uint64


def _draws_table() -> np.ndarray:
    """Draws by the first 16 bits of a hash; 255 where the other bits decide."""
    cells = np.arange(1 << 16, dtype=_U) << _U(48)
    low, high = (np.searchsorted(_CDF, ((cells | _U(more)) >> _U(11)) * 2.0 ** -53, side="right") for more in (0, (1 << 48) - 1))
    return np.where(low == high, low, 255).astype(np.uint8)


_DRAWS = _draws_table()


def bin_edges(train: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Thresholds of each feature: between all values if there are few, else at quantiles of the rows."""
    shares = [i / 1000 for i in range(1001)]
    found = train.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 10_000).alias(f"c{i}") for i, f in enumerate(features)]).first()
    edges = []
    for line in found:
        line = np.array([x for x in line or [] if np.isfinite(x)])
        values = np.unique(line)
        few = len(values) <= BINS
        edges.append((values[1:] + values[:-1]) / 2 if few else np.unique(line[[len(line) * j // BINS for j in range(1, BINS)]]))
    return edges


def _binned(df: DataFrame, features: Sequence[str], edges: list[np.ndarray], extra: str = "") -> DataFrame:
    """``_row``, ``bins`` (a byte per feature; missing values come last) and the long columns ``extra``."""
    more = extra.split()

    def run(batches):
        for b in batches:
            x = [np.searchsorted(e, b.column(i).to_numpy(zero_copy_only=False)) for i, e in enumerate(edges)]
            bins = np.stack(x, 1).astype(np.uint8) if x else np.empty((b.num_rows, 0), np.uint8)
            at = len(edges)
            ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(at))
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column(at), packed, *(b.column(at + 1 + i) for i in range(len(more)))], ["_row", "bins", *more])

    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(features)], "_row", *more)
    return rows.mapInArrow(run, ", ".join(["_row long", "bins binary", *(f"{c} {df.schema[c].dataType.simpleString()}" for c in more)]))


def _times(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    x = rows.astype(_U)
    x += _U(1)
    x *= _U(0x9E3779B97F4A7C15)
    x += _U((seed * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(by)
    x ^= x >> _U(31)
    times = _DRAWS[(x >> _U(48)).view(np.int64)]
    at = np.flatnonzero(times == 255)
    times[at] = np.searchsorted(_CDF, (x[at] >> _U(11)) * 2.0 ** -53, side="right")
    return times


def best_splits(hist: np.ndarray, weights: np.ndarray, leaf: int):
    """Of histograms (node, feature, bin, class): whether a split gains, its feature's place, its bin, and the left counts."""
    left = hist.cumsum(2)
    whole = left[:, :1, -1:]
    right = whole - left
    pure = np.zeros(left.shape[:3])
    for side in (left, right):
        heavy = side * weights
        pure += (heavy ** 2).sum(3) / np.maximum(heavy.sum(3), 1e-300)
        pure[side.sum(3) < leaf] = -np.inf
    flat = pure.reshape(len(hist), -1)
    at = flat.argmax(1)
    heavy = whole[:, 0, 0] * weights
    base = (heavy ** 2).sum(1) / np.maximum(heavy.sum(1), 1e-300)
    place, cut = np.divmod(at, hist.shape[2])
    n = np.arange(len(hist))
    return flat[n, at] > base * (1 + 1e-12), place, cut, left[n, place, cut]


def _open(counts: np.ndarray, leaf: int) -> np.ndarray:
    """Nodes that may be split: two leaves fit in, and there are two classes."""
    return (counts.sum(1) >= 2 * leaf) & ((counts > 0).sum(1) > 1)


def _subset(rng, nodes: int, k: int, size: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, k)), 1)[:, :size]


def _slices(lens: np.ndarray, nodes: int, rows: int):
    """Places (from, to, first row, last row) of runs of nodes of so many nodes and rows at most, or of one node."""
    ends, a = np.cumsum(lens), 0
    while a < len(lens):
        begin = ends[a] - lens[a]
        b = max(a + 1, min(a + nodes, int(np.searchsorted(ends, begin + rows, side="right"))))
        yield a, b, int(begin), int(ends[b - 1])
        a = b


class _Packed:
    """Counts several classes in one double: ``per`` classes of 52 // per bits each, exact below that.

    A row's ``code`` is its class and how often it was drawn, a byte of it.
    """

    def __init__(self, classes: int, per: int):
        self.classes, self.per, self.bits = classes, per, 52 // per
        self.words = -(-classes // per)
        y = np.repeat(np.arange(classes), 256)
        self.w = np.tile(np.arange(256.0), classes) * np.exp2(self.bits * (y % per))
        self.word = (y // per) * BINS if self.words > 1 else None

    def best(self, flat, n, rows, codes, lens, pick, counts, weights, leaf):
        """``best_splits`` of neighbouring nodes: only bins that hold rows are tried, and only sums that leave two leaves."""
        m, size, words, per = len(lens), pick.shape[1], self.words, self.per
        hist = np.zeros((m, size, words, BINS), np.int64)
        for s in range(0, len(rows), ROWS) if m == 1 else (0,):
            r, code = (v[s:s + ROWS] if m == 1 else v for v in (rows, codes))
            r, code = r.astype(np.int64), code.astype(np.int64)
            w = self.w[code]
            base = None if self.word is None else self.word[code]
            if m > 1:
                node = np.repeat(np.arange(0, m * words * BINS, words * BINS), lens)
                base = node if base is None else base + node
            for j in range(size):
                at = np.repeat(pick[:, j] * n, lens) if m > 1 else pick[0, j] * n
                at = flat[at + r]
                at = at.astype(np.int64) if base is None else base + at
                hist[:, j] += np.bincount(at, w, m * words * BINS).reshape(m, words, BINS).astype(np.int64)
        left = hist.cumsum(3)
        some = (hist if words == 1 else hist.any(2)) != 0
        e = np.flatnonzero(some)
        node = e // (size * BINS)
        held, whole = [], counts.sum(1)
        for word in range(words):
            packed = left[:, :, word].reshape(-1)[e]
            for q in range(min(per, self.classes - word * per)):
                held.append((packed >> self.bits * q) & ((1 << self.bits) - 1))
        total = sum(held[1:], held[0])
        fit = np.flatnonzero((total >= leaf) & (whole[node] - total >= leaf))
        e, node = e[fit], node[fit]
        ok, place, cut, lefts = np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, self.classes))
        if not len(e):
            return ok, place, cut, lefts
        held = [h[fit].astype(np.float64) for h in held]
        one = [np.zeros(len(e)) for _ in range(4)]  # of both sides: the sum of squares, the sum
        for q, h in enumerate(held):
            for at, heavy in ((0, h * weights[q]), (2, (counts[node, q] - h) * weights[q])):
                one[at + 1] += heavy
                heavy *= heavy
                one[at] += heavy
        pure = one[0] / np.maximum(one[1], 1e-300) + one[2] / np.maximum(one[3], 1e-300)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        top = np.maximum.reduceat(pure, first)
        reached = np.flatnonzero(pure == np.repeat(top, np.diff(first, append=len(e))))
        reached = reached[np.diff(node[reached], prepend=-1) != 0]  # the first place with the maximum
        at = node[first]
        heavy = counts[at] * weights
        base = (heavy ** 2).sum(1) / np.maximum(heavy.sum(1), 1e-300)
        gains = top > base * (1 + 1e-12)
        at, reached = at[gains], reached[gains]
        ok[at], cut[at], place[at] = True, e[reached] % BINS, e[reached] // BINS % size
        lefts[at] = np.stack([h[reached] for h in held], 1)
        return ok, place, cut, lefts


def grow(x: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, depth: int, leaf: int, rng):
    """A subtree as (feature, cut, left child, class counts) per node, level by level; -1 is no feature, right is left + 1.

    Rows lie node by node: a level's left children in the order of their parents, then the right ones; ``ids`` are the
    nodes' numbers within the level.
    """
    (n, k), classes = x.shape, len(weights)
    size = int(np.ceil(np.sqrt(k)))
    flat = np.ascontiguousarray(x.T).reshape(-1)
    levels = [np.bincount(y, times, classes)[None]]
    drawn = levels[0].sum()
    small = 1 << 52 // 4  # nodes below it are counted four classes a double, the others two or one
    packers = {per: _Packed(classes, per) for per in (4, 2 if drawn < 1 << 26 else 1)}
    codes = y.astype(np.uint16 if classes <= 256 else np.uint32) * 256 + times
    feature, cut, child = [], [], []
    at, lens, ids, made = np.arange(n, dtype=np.int32), np.array([n]), np.zeros(1, np.int64), 1
    for d in range(depth + 1):
        counts = levels[-1]
        may = _open(counts, leaf) if d < depth else np.zeros(len(counts), bool)
        m = int(may.sum())
        keep = may[ids]
        if not keep.all():  # the rows of closed nodes are done
            held = np.repeat(keep, lens)
            at, codes, lens, ids = at[held], codes[held], lens[keep], ids[keep]
        ids = (np.cumsum(may) - 1)[ids]
        pick = np.empty((m, size), np.int64)
        for s in range(0, m, 4096):
            pick[s:s + 4096] = _subset(rng, min(4096, m - s), k, size)
        opened = counts[may]
        heaviest = opened.sum(1)
        ok, chosen, cuts, lefts = np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, classes))
        turn, rights = np.full(len(at), 2, np.uint8), np.zeros(len(lens), np.int64)  # 0 goes left, 1 right, 2 nowhere
        for a, b, begin, end in _slices(lens, NODES, ROWS):
            here, rows, size_of = ids[a:b], at[begin:end], lens[a:b]
            packer = packers[4 if heaviest[here].max() < small else min(packers)]
            good, j, c, left = packer.best(flat, n, rows, codes[begin:end], size_of, pick[here], opened[here], weights, leaf)
            f = pick[here, j]
            ok[here], chosen[here], cuts[here], lefts[here] = good, f, c, left
            if b - a == 1:
                if good[0]:
                    turn[begin:end] = flat[f[0] * n:(f[0] + 1) * n][rows] > c[0]
                    rights[a] = turn[begin:end].sum(dtype=np.int64)
            elif good.any():
                side = (flat[np.repeat(f * n, size_of) + rows] > np.repeat(c, size_of)).view(np.uint8)
                rights[a:b] = np.add.reduceat(side, np.cumsum(size_of) - size_of, dtype=np.int64)
                turn[begin:end] = side if good.all() else np.where(np.repeat(good, size_of), side, 2)
        first = np.where(ok, made + 2 * (np.cumsum(ok) - 1), -1)
        for out, values in ((feature, np.where(ok, chosen, -1)), (cut, cuts), (child, first)):
            line = np.full(len(counts), -1 if out is not cut else 0, np.int64)
            line[may] = values
            out.append(line)
        if not ok.any():
            break
        levels.append(np.stack([lefts[ok], opened[ok] - lefts[ok]], 1).reshape(-1, classes))
        good = ok[ids]
        rights, lens, below = rights[good], lens[good], first[ids[good]] - made
        zero, one = turn == 0, turn == 1
        at, codes = np.concatenate([at[zero], at[one]]), np.concatenate([codes[zero], codes[one]])
        lens, ids = np.concatenate([lens - rights, rights]), np.concatenate([below, below + 1])
        made += len(levels[-1])
        if d % 4 == 3 and n > ROWS:  # neighbours in a node become neighbours in memory
            laid = np.empty(k * len(at), np.uint8)
            for f in range(k):
                laid[f * len(at):(f + 1) * len(at)] = flat[f * n:(f + 1) * n][at]
            flat, n = laid, len(at)
            at = np.arange(n, dtype=np.int32)
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(levels)


def _dump(feature, cut, child, counts) -> bytes:
    """A subtree in short: a feature for each node, a cut for each split, class counts for each leaf.

    ``grow`` numbers children in the order of their parents, so that they need no numbers here.
    """
    ends = feature < 0
    low = counts[ends]
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if low.max() <= np.iinfo(t).max)
    return struct.pack("<q2s", len(feature), kind[1:].encode()) + feature.astype("<i2").tobytes() + cut[~ends].astype(np.uint8).tobytes() + low.astype(
        kind).tobytes()


def _load(data: bytes, weights: np.ndarray):
    """(feature, cut, left child, class shares) per node; a split has no shares."""
    n, kind = struct.unpack_from("<q2s", data)
    at = struct.calcsize("<q2s")
    feature = np.frombuffer(data, "<i2", n, at)
    ends = feature < 0
    splits = n - int(ends.sum())
    cut, child, shares = np.zeros(n, np.uint8), np.full(n, -1, np.int64), np.zeros((n, len(weights)), np.float32)
    cut[~ends] = np.frombuffer(data, np.uint8, splits, at + 2 * n)
    child[~ends] = 1 + 2 * np.arange(splits)
    heavy = np.frombuffer(data, f"<{kind.decode()}", (n - splits) * len(weights), at + 2 * n + splits).reshape(-1, len(weights)) * weights
    shares[ends] = heavy / np.maximum(heavy.sum(1, keepdims=True), 1e-300)
    return feature, cut, child, shares


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    out, (n, k) = np.zeros(len(x), np.int64), x.shape
    leaf = feature < 0
    if leaf.all() or not n:
        return out
    # a word per node: child, cut and feature; at a leaf no value is above the cut, and the child is the leaf
    words = np.where(leaf, (np.arange(len(feature)) << 24) | (255 << 16),
                     (child.astype(np.int64) << 24) | (cut.astype(np.int64) << 16) | feature.astype(np.int64))
    flat = np.ascontiguousarray(x).reshape(-1)
    for s in range(0, n, ROWS):
        e = min(s + ROWS, n)
        base, node, going, turn = np.arange(s * k, e * k, k), np.zeros(e - s, np.int64), None, 0
        while len(base):
            word = words[node]
            new = word >> 24
            new += flat[base + (word & 0xFFFF)] > ((word >> 16) & 0xFF)
            turn += 1
            if turn % 3 == 0:  # rows at their leaf are done
                left = np.flatnonzero(new != node)
                if len(left) < 0.8 * len(new):
                    if going is None:
                        out[s:e], going = new, np.arange(s, e)
                    else:
                        out[going] = new
                    base, new, going = base[left], new[left], going[left]
            node = new
    return out


def _chunks(batches, size: int):
    """Batches put together to ``size`` rows and more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _bytes(table: pa.Table, k: int) -> np.ndarray:
    parts = []
    for c in table.column("bins").chunks if k else ():
        c = c.cast(pa.binary())
        if len(c):
            first = int(np.frombuffer(c.buffers()[1], np.int32, 1, 4 * c.offset)[0])
            parts.append(np.frombuffer(c.buffers()[2], np.uint8, len(c) * k, first))
    whole = parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint8), *parts])
    return whole.reshape(-1, k) if k else np.empty((table.num_rows, 0), np.uint8)


def _route(columns: np.ndarray, at: np.ndarray, top, wanted: set | None = None):
    """The nodes without a split in which the rows ``at`` end, each with its rows in their order.

    With ``wanted`` only those nodes are gone through.
    """
    feature, cut, child = top[:3]
    going = [(0, at)] if wanted is None or 0 in wanted else []
    while going:
        node, rows = going.pop()
        if feature[node] < 0:
            if len(rows):
                yield node, rows
            continue
        right = columns[feature[node]][rows] > cut[node]
        for side, below in ((right, int(child[node]) + 1), (None, int(child[node]))):
            if wanted is None or below in wanted:
                going.append((below, rows[~right if side is None else side]))


class Forest:
    """Trees as a table (tree, node, subtree) below the few splits of large nodes, which ``tops`` holds."""

    def __init__(self, features: list[str], edges: list[np.ndarray], weights: np.ndarray, tops: list, table: DataFrame):
        self.features, self.edges, self.weights, self.tops, self.table = features, edges, weights, tops, table


def _above(top, nodes: set) -> set:
    """The nodes and all that lie above them."""
    parent = {int(c) + i: node for node, c in enumerate(top[2]) if c >= 0 for i in (0, 1)}
    found = set()
    for node in nodes:
        while node is not None and node not in found:
            found.add(node)
            node = parent.get(node)
    return found


def _top_round(rows: DataFrame, tops: list, big: list[set], weights: np.ndarray, k: int, leaf: int, seed: int):
    """The best splits of large nodes, from histograms that each task makes of its rows."""
    size, classes = int(np.ceil(np.sqrt(k))), len(weights)
    pick = lambda tree, node: _subset(np.random.default_rng([seed, tree, node, 1]), 1, k, size)[0]

    def count(batches):
        sums = {}
        for t in _chunks(batches, ROWS):
            x, y, ids = _bytes(t, k), t.column("label").to_numpy().astype(np.int64), t.column("_row").to_numpy()
            columns = np.ascontiguousarray(x.T)
            for tree, nodes in enumerate(big):
                if not nodes:
                    continue
                times = _times(ids, tree, seed)
                for node, at in _route(columns, np.flatnonzero(times), tops[tree], wanted[tree]):
                    label, often = y[at], times[at].astype(np.float64)
                    hist = np.stack([np.bincount(columns[f][at] * np.int64(classes) + label, often, BINS * classes) for f in pick(tree, node)])
                    sums[tree, node] = sums.get((tree, node), 0) + hist
        for (tree, node), hist in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": [tree], "node": [node], "hist": [hist.tobytes()]})

    def split(key, t):
        tree, node = (v.as_py() for v in key)
        hist = sum(np.frombuffer(h, np.float64) for h in t.column("hist").to_pylist()).reshape(1, size, BINS, classes)
        ok, place, cut, left = best_splits(hist, weights, leaf)
        whole = hist[0, 0].sum(0)
        return pa.table({"tree": [tree], "node": [node], "feature": [int(pick(tree, node)[place[0]]) if ok[0] else -1],
                         "cut": [int(cut[0])], "left": [left[0].tolist()], "right": [(whole - left[0]).tolist()]})

    wanted = [_above(top, nodes) for top, nodes in zip(tops, big)]
    parts = rows.mapInArrow(count, "tree long, node long, hist binary")
    return parts.groupBy("tree", "node").applyInArrow(
        split, "tree long, node long, feature long, cut long, left array<double>, right array<double>").collect()


def fit_forest(train: DataFrame, features: Sequence[str], label: str, weight: str, trees: int, depth: int, leaf: int, seed: int,
               local: int = LOCAL) -> Forest:
    """Grow a forest; ``weight`` is one number per class."""
    features, k = list(features), len(features)
    code = F.col(f"`{label}`")
    sure = F.when(code.isNull() | (code < 0), F.raise_error(F.lit("labels are whole numbers from 0 up")).cast("int")).otherwise(code.cast("int"))
    values = [F.col(f"`{f}`").cast("double") for f in features]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for v in values])  # NaN is above all
    sure = F.when(whole, sure).otherwise(F.raise_error(F.lit("features are finite numbers in training")).cast("int"))
    edges = bin_edges(train, features)
    rows = train.withColumns({"_row": F.monotonically_increasing_id(), "_y": sure, "_w": F.col(f"`{weight}`").cast("double")})
    rows = rows.select(*[F.col(f"`{f}`") for f in features], "_row", F.col("_y").alias("label"), F.col("_w").alias("weight"))
    rows = settle(_binned(rows, features, edges, "label weight"), "binned")
    known = rows.groupBy("label").agg(F.max("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()  # a row per class
    if not known:
        raise ValueError("no training rows")
    weights = np.zeros(max(r["label"] for r in known) + 1)
    for r in known:
        weights[r["label"]] = r["w"]
    classes, n = len(weights), sum(r["n"] for r in known)
    # every row is drawn for every tree: work for all cores, however few files the rows lie in
    rows = rows.repartition(n // CHUNK + train.sparkSession.sparkContext.defaultParallelism, "_row")
    # a top: feature, cut and child per node, and each node's depth; nodes without a feature have a subtree in the table
    tops = [tuple(np.array([v], np.int64) for v in (-1, 0, -1, 0)) for _ in range(trees)]
    big = [{0} if n > local and depth else set() for _ in range(trees)]
    while any(big):
        found, big = _top_round(rows, tops, big, weights, k, leaf, seed), [set() for _ in range(trees)]
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            if r["feature"] < 0:
                continue
            feature, cut, child, level = tops[r["tree"]]
            node, first = r["node"], len(feature)
            feature[node], cut[node], child[node] = r["feature"], r["cut"], first
            below = level[node] + 1
            tops[r["tree"]] = tuple(np.append(old, new) for old, new in zip(
                (feature, cut, child, level), ([-1, -1], [0, 0], [-1, -1], [below, below])))
            if below < depth:
                big[r["tree"]] |= {first + i for i, side in enumerate(("left", "right")) if sum(r[side]) > local}

    kind = np.uint8 if classes <= 256 else np.int32

    def deal(batches):
        for t in _chunks(batches, CHUNK):
            x, y, ids = _bytes(t, k), t.column("label").to_numpy().astype(kind), t.column("_row").to_numpy()
            columns = np.ascontiguousarray(x.T)
            for tree, top in enumerate(tops):
                times = _times(ids, tree, seed)
                parts = [(node, x[at], at) for node, at in _route(columns, np.flatnonzero(times), top)]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(parts), pa.int64()), "node": pa.array([p[0] for p in parts], pa.int64()),
                    "x": pa.array([p[1].tobytes() for p in parts], pa.binary()), "y": pa.array([y[p[2]].tobytes() for p in parts], pa.binary()),
                    "times": pa.array([times[p[2]].tobytes() for p in parts], pa.binary())})

    def finish(key, t):
        tree, node = (v.as_py() for v in key)
        y, times = (np.concatenate([np.frombuffer(v.as_buffer(), of) for v in t.column(c)]) for c, of in (("y", kind), ("times", np.uint8)))
        columns, at = np.empty((k, len(y)), np.uint8), 0
        for v in t.column("x") if k else ():
            part = np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, k)
            columns[:, at:at + len(part)] = part.T
            at += len(part)
        rng = np.random.default_rng([seed, tree, node])
        blob = _dump(*grow(columns.T, y, times, weights, depth - int(tops[tree][3][node]), leaf, rng))
        return pa.table({"tree": pa.array([tree], pa.int64()), "node": pa.array([node], pa.int64()), "subtree": pa.array([blob], pa.binary())})

    ends = sum(int((top[0] < 0).sum()) for top in tops)
    dealt = rows.mapInArrow(deal, "tree long, node long, x binary, y binary, times binary").repartition(ends, "tree", "node")
    table = dealt.groupBy("tree", "node").applyInArrow(finish, "tree long, node long, subtree binary")
    return Forest(features, edges, weights, tops, settle(table, "forest"))


def predict_forest(test: DataFrame, forest: Forest) -> DataFrame:
    """The rows with ``prediction``: the first class with most votes, each tree voting with its leaf's shares."""
    k, weights, tops = len(forest.features), forest.weights, forest.tops
    classes = len(weights)
    rows = settle(test.withColumn("_row", F.monotonically_increasing_id()), "scored")
    parts = rows.count() // SCORED + 1

    def pack(batches):
        for t in _chunks(batches, SCORED):
            ids = t.column("_row").to_numpy().astype("<i8")
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(ids[:1], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()),
                                              "x": pa.array([_bytes(t, k).tobytes()], pa.binary())})

    chunks = settle(_binned(rows, forest.features, forest.edges).repartition(parts).mapInArrow(
        pack, "chunk long, ids binary, x binary"), "chunks")
    blocks = -(-len(tops) // BLOCK)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = chunks.select("chunk", "x", every.alias("block"))
    right = forest.table.withColumn("of_block", (F.col("tree") / BLOCK).cast("long")).crossJoin(
        F.broadcast(chunks.select(F.col("chunk").alias("of_chunk"))))

    def vote(key, one, some):
        x = np.frombuffer(one.column("x")[0].as_py(), np.uint8).reshape(-1, k)
        votes = np.zeros((len(x), classes))
        columns, every_row = np.ascontiguousarray(x.T), np.arange(len(x))
        subtrees = dict(zip(zip(some.column("tree").to_pylist(), some.column("node").to_pylist()), some.column("subtree")))
        for tree in sorted({tree for tree, _ in subtrees}):
            for node, at in _route(columns, every_row, tops[tree]):
                *arrays, shares = _load(subtrees[tree, node].as_py(), weights)
                votes[at] += shares[_walk(x if len(at) == len(x) else x[at], *arrays)]
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()),
                         "votes": pa.array([votes.astype("<f4").tobytes()], pa.binary())})

    # few keys, long work: partitions of a given number are not put together, and few of them get two keys
    spread = 4 * parts * blocks
    left, right = left.repartition(spread, "chunk", "block"), right.repartition(spread, "of_chunk", "of_block")
    votes = left.groupBy("chunk", "block").cogroup(right.groupBy("of_chunk", "of_block")).applyInArrow(
        vote, "chunk long, block long, votes binary")

    def count(key, one, some):
        ids = np.frombuffer(one.column("ids")[0].as_py(), "<i8")
        total = np.zeros((len(ids), classes))
        for i in np.argsort(some.column("block").to_numpy()).tolist():
            total += np.frombuffer(some.column("votes")[i].as_py(), "<f4").reshape(-1, classes)
        return pa.table({"_row": pa.array(ids, pa.int64()), "prediction": pa.array(total.argmax(1), pa.int64())})

    found = chunks.select("chunk", "ids").groupBy("chunk").cogroup(settle(votes, "votes").groupBy("chunk")).applyInArrow(
        count, "_row long, prediction long")
    return rows.join(found, "_row").drop("_row")


# executors need no copy of this module: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
