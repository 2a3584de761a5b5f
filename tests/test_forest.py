"""The forest: against plain loops, MLlib, and itself with large nodes split by all tasks."""

import random
from itertools import pairwise

import numpy as np
import pytest

from triagemill.operators import forest as FO
from triagemill.operators import policy as P


def rows_of(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.randrange(8), rng.random()
        rows.append((i, (a > 0.5) + 2 * (b % 2) if rng.random() > 0.05 else rng.randrange(4), a, float(b), c, None if i % 9 == 0 else a))
    return spark.createDataFrame(rows, "id long, grade_code long, a double, b double, c double, d double")


def share(df):
    got = [(r.grade_code, r.prediction) for r in df.select("grade_code", "prediction").collect()]
    return sum(y == z for y, z in got) / len(got)


@pytest.mark.parametrize("local", [FO.LOCAL, 400])
def test_forest_is_as_good_as_mllibs(spark, local):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = rows_of(spark, 3000)
    train, test, names = df.filter("id < 2000"), df.filter("id >= 2000"), ["a", "b", "c"]
    weighted = P.class_weights(train, "grade_code")
    made = FO.fit_forest(weighted, names, "grade_code", "weight", 40, 8, 5, 42, local)
    ours = FO.predict_forest(test, made)
    assert sorted(r.id for r in ours.collect()) == list(range(2000, 3000))
    assert ours.columns == [*df.columns, "prediction"]
    make = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="keep")
    theirs = RandomForestClassifier(featuresCol="x", labelCol="grade_code", weightCol="weight", numTrees=40, maxDepth=8, minInstancesPerNode=5, seed=42)
    theirs = theirs.fit(make.transform(weighted)).transform(make.transform(test))
    assert share(ours) > share(theirs) - 0.02
    # every tree has a subtree below each end of its top; large nodes were split by all tasks, and only they
    ends = {(tree, int(node)) for tree, top in enumerate(made.tops) for node in np.flatnonzero(top[0] < 0)}
    assert {(r.tree, r.node) for r in made.table.select("tree", "node").collect()} == ends
    assert (len(ends) > 40) == (local < 2000)


def test_splits_equal_plain_loops():
    rng = np.random.default_rng(5)
    weights, leaf = np.array([1.0, 0.5, 2.0]), 3
    hist = rng.integers(0, 6, (40, 2, 5, 1)) * rng.integers(0, 2, (40, 2, 5, 3)).astype(float)
    hist[:, 1] = hist[:, 1].sum(1, keepdims=True) * 0
    hist[:, 1, 0] = hist[:, 0].sum(1)  # the second feature is constant
    ok, place, cut, left = FO.best_splits(hist, weights, leaf)

    def gini(h):
        w = h * weights
        return w.sum() - (w ** 2).sum() / w.sum() if w.sum() else 0.0

    for i, h in enumerate(hist):
        best = None
        for j in range(2):
            for b in range(5):
                one, two = h[j, :b + 1].sum(0), h[j, b + 1:].sum(0)
                if one.sum() >= leaf and two.sum() >= leaf:
                    gain = gini(h[j].sum(0)) - gini(one) - gini(two)
                    best = gain if best is None else max(best, gain)
        assert ok[i] == (best is not None and best > 1e-9)
        if ok[i]:
            got = gini(h[0].sum(0)) - gini(left[i]) - gini(h[0].sum(0) - left[i])
            assert got == pytest.approx(best) and place[i] == 0
            assert (left[i] == h[0, :cut[i] + 1].sum(0)).all()


def test_subtrees_keep_their_leaves_and_depth():
    rng = np.random.default_rng(6)
    x, y, times = rng.integers(0, 32, (5000, 3)).astype(np.uint8), rng.integers(0, 3, 5000), rng.integers(1, 3, 5000).astype(np.uint8)
    feature, cut, child, counts = FO.grow(x, y, times, np.ones(3), 20, 5, rng)
    ends = FO._walk(x, feature, cut, child)
    assert (feature < 0)[ends].all() and len(feature) > 1024
    for node in np.unique(ends):
        assert (counts[node] == np.bincount(y[ends == node], times[ends == node], 3)).all() and counts[node].sum() >= 5
    feature, _, child, _ = FO.grow(x, y, times, np.ones(3), 2, 5, rng)
    assert len(feature) == 7 and all(a < b for a, b in pairwise(child[child > 0]))


def test_trees_equal_plain_recursion():
    """With two features no subset is drawn, so the whole tree is known."""
    rng = np.random.default_rng(8)
    x, y, times = rng.integers(0, 9, (600, 2)).astype(np.uint8), rng.integers(0, 3, 600), rng.integers(1, 4, 600).astype(np.uint8)
    weights = np.array([1.0, 0.7, 1.9])
    feature, cut, child, counts = FO.grow(x, y, times, weights, 6, 5, rng)

    def pure(at):
        w = np.bincount(y[at], times[at], 3) * weights
        return (w ** 2).sum() / w.sum()

    def check(node, at, depth):
        assert (counts[node] == np.bincount(y[at], times[at], 3)).all()
        gains = {}
        for f in range(2):
            for c in range(8):
                one, two = at[x[at, f] <= c], at[x[at, f] > c]
                if depth < 6 and times[one].sum() >= 5 and times[two].sum() >= 5:
                    gains[f, c] = pure(one) + pure(two) - pure(at)
        if not gains or max(gains.values()) < 1e-9:
            assert feature[node] == -1
            return 1
        f, c = feature[node], cut[node]
        assert gains[f, c] == pytest.approx(max(gains.values()))
        return 1 + check(child[node], at[x[at, f] <= c], depth + 1) + check(child[node] + 1, at[x[at, f] > c], depth + 1)

    assert check(0, np.arange(600), 0) == len(feature) > 40


def test_labels_must_be_known(spark):
    train = spark.createDataFrame([(None, 1.0, 1.0), (1, 2.0, 1.0)], "grade_code long, a double, weight double")
    with pytest.raises(Exception, match="whole numbers"):
        FO.fit_forest(train, ["a"], "grade_code", "weight", 2, 2, 1, 42)
    for bad in (None, float("nan"), float("inf")):
        train = spark.createDataFrame([(0, bad, 1.0), (1, 2.0, 1.0)], "grade_code long, a double, weight double")
        with pytest.raises(Exception, match="finite numbers"):
            FO.fit_forest(train, ["a"], "grade_code", "weight", 2, 2, 1, 42)
    with pytest.raises(ValueError, match="no training rows"):
        FO.fit_forest(train.limit(0), ["a"], "grade_code", "weight", 2, 2, 1, 42)


def test_rows_are_coded_and_written_once_for_all_regressors(spark, monkeypatch):
    """Without that, each of the three regressors computes its input again."""
    df = rows_of(spark, 200)
    labels = []
    monkeypatch.setattr(P, "settle", lambda t, label="table", real=P.settle: (labels.append(label), real(t, label))[1])
    model = P.fit_action_values_ml(df, ["a", "b", "c"])
    assert labels == ["fitted"]
    assert P.score_ml(df, model).select("q0", "q1", "q2").filter("q0 is null").count() == 0


def test_training_rows_are_computed_once(spark):
    """Class counts are taken from the written rows, not from the plan that codes them."""
    df = rows_of(spark, 300)
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    train = df.mapInArrow(look, df.schema)
    out = P.grade_baseline(train, df, ["a", "b", "c"], trees=2, depth=3)
    assert seen.value == 300
    assert sorted(r.id for r in out.select("id").collect()) == list(range(300))


@pytest.mark.parametrize("classes, heavy", [(1, 3), (3, 40), (4, 3), (6, 3), (9, 200)])
def test_trees_equal_those_of_whole_histograms(monkeypatch, classes, heavy):
    """Several classes in one double, blocks of nodes and rows, rows laid out anew: none of it changes a tree."""
    rng = np.random.default_rng(classes)
    n, k, leaf = 3000, 5, 4
    x, times = rng.integers(0, 32, (n, k)).astype(np.uint8), rng.integers(1, heavy, n).astype(np.uint8)
    y = (x[:, 0] // 8 + x[:, 3] // 4 + rng.integers(0, 2, n)) % classes
    weights = rng.random(classes) + 0.5
    made = FO.grow(x, y, times, weights, 12, leaf, np.random.default_rng(7))
    monkeypatch.setattr(FO, "ROWS", 50)
    monkeypatch.setattr(FO, "NODES", 3)
    for one, two in zip(made, FO.grow(x, y, times, weights, 12, leaf, np.random.default_rng(7))):
        assert (one == two).all()
    feature, cut, child, counts = made
    picks, level, d = np.random.default_rng(7), {0: np.arange(n)}, 0
    while level:
        may = {i: at for i, at in level.items() if d < 12 and FO._open(counts[i:i + 1], leaf)[0]}
        pick, below = FO._subset(picks, len(may), k, 3), {}
        assert all(feature[i] == -1 for i in level if i not in may)
        for p, (i, at) in zip(pick, sorted(may.items())):
            assert (counts[i] == np.bincount(y[at], times[at], classes)).all()
            hist = np.stack([np.bincount(x[at, f].astype(int) * classes + y[at], times[at], 32 * classes) for f in p]).reshape(1, 3, 32, classes)
            ok, place, c, _ = FO.best_splits(hist, weights, leaf)
            assert (feature[i], cut[i]) == ((p[place[0]], c[0]) if ok[0] else (-1, 0))
            if ok[0]:
                right = x[at, feature[i]] > cut[i]
                below |= {int(child[i]): at[~right], int(child[i]) + 1: at[right]}
        level, d = below, d + 1
    assert len(feature) == 1 if classes == 1 else len(feature) > 40


def test_subtrees_are_short_and_come_back_whole():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 32, (4000, 6)).astype(np.uint8), rng.integers(0, 4, 4000)
    weights = np.array([1.0, 0.7, 1.9, 1.1])
    for times in (np.ones(4000, np.uint8), np.full(4000, 200, np.uint8)):
        for depth in (0, 1, 20):
            feature, cut, child, counts = FO.grow(x, y, times, weights, depth, 5, rng)
            blob = FO._dump(feature, cut, child, counts)
            assert len(blob) <= 40 + (7 if times[0] == 1 and depth == 20 else 11) * len(feature)
            f, c, below, shares = FO._load(blob, weights)
            ends, heavy = feature < 0, counts * weights
            assert (f == feature).all() and (below == child).all() and (c[~ends] == cut[~ends]).all()
            assert (shares[ends] == (heavy / heavy.sum(1, keepdims=True)).astype("f4")[ends]).all()


def test_rows_walk_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(10)
    x, y = rng.integers(0, 32, (2000, 4)).astype(np.uint8), rng.integers(0, 3, 2000)
    feature, cut, child, _ = FO.grow(x, y, np.ones(2000, np.uint8), np.ones(3), 20, 1, rng)
    monkeypatch.setattr(FO, "ROWS", 700)
    found = FO._walk(x, feature, cut, child)
    for row, end in zip(x, found):
        node = 0
        while feature[node] >= 0:
            node = child[node] + (row[feature[node]] > cut[node])
        assert node == end
    columns, tree, some = np.ascontiguousarray(x.T), (feature, cut, child), np.arange(0, 2000, 3)
    parts = dict(FO._route(columns, some, tree))
    assert set(parts) == set(found[some].tolist())
    assert all((some[found[some] == node] == part).all() for node, part in parts.items())
    nodes = set(sorted(parts)[:5])
    above = FO._above(tree, nodes)
    assert {node for node, _ in FO._route(columns, some, tree, above)} == nodes and 0 in above and len(above) < len(feature)
    assert list(FO._route(columns, some, tree, set())) == [] and list(FO._route(columns, some[:0], tree)) == []


def test_draws_follow_the_poisson_shares():
    draws = FO._times(np.arange(400_000), 3, 42)
    for often, most in enumerate(np.diff(FO._CDF[:5], prepend=0)):
        assert (draws == often).mean() == pytest.approx(most, abs=0.004)
    assert (FO._DRAWS == 255).sum() <= 16 and draws.max() < 16


def test_chunks_and_deals_do_not_change_predictions(spark, monkeypatch):
    df = rows_of(spark, 1500)
    train, test, names = df.filter("id < 1000"), df.filter("id >= 1000"), ["a", "b", "c"]
    weighted, found = P.class_weights(train, "grade_code"), []
    for size in (FO.CHUNK, 90):
        monkeypatch.setattr(FO, "CHUNK", size)
        monkeypatch.setattr(FO, "SCORED", size)
        made = FO.fit_forest(weighted, names, "grade_code", "weight", 12, 8, 5, 42, 300)
        found.append({r.id: r.prediction for r in FO.predict_forest(test, made).collect()})
    assert found[0] == found[1] and len(found[0]) == 500
