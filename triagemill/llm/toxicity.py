"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with its edges) and of the whole word, so words
never seen share vectors with their misspellings.  Vectors and softmax are trained jointly in numpy.  A long text with
one insult must not drown in its average: the softmax sees the average of a window of words, and a text is judged by its
worst window.  Training therefore alternates: first random windows take the label of their text, then each text
trains on the window that the model now finds worst.  A part of the sample stays outside the training and sets the
scale that turns worst-window values into scores.

The model is fitted on a bounded sample of labelled rows (``per_class`` texts of either class, those with the smallest
hashes of their id); every text is scored, wholly.  The softmax is linear, so a word's contribution is one number and
scoring a text is a running mean of numbers.

Cases: null and empty texts have no words and get the score of the middle clean text of the sample; labels that are null, or of ids that
have no text, are not used; of several labels of an id the largest counts; without both classes every score is the share
of toxic labels (0 without labels); repeated rows give repeated rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.common import ship

WORD = re.compile(r"\w*[^\W\d_]\w*")  # words with a letter
PER_CLASS, BUCKETS, WIDTH, WINDOW, BATCH = 1500, 1 << 18, 8, 8, 128
SHORT, LONG = 3, 5  # lengths of the character n-grams
REMEMBERED = 600_000  # distinct words whose values a worker keeps


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    w = f"<{word}>"
    parts = [w] + [w[i:i + n] for n in range(SHORT, LONG + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Model:
    values: np.ndarray  # what each bucket adds to the logit of "toxic"
    bias: float
    slope: float
    shift: float
    usual: float = 0.0  # what a repetition counts: the mean word of the clean texts
    blank: float = 0.0  # the window value of a text without words: that of the middle clean text

    def word(self, word: str) -> float:
        return float(self.values[subwords(word)].mean())

    def score(self, worst: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (worst + self.bias) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def fresh(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words of a text are no repetition within their window; repetitions say nothing new."""
    order = np.argsort(ids, kind="stable")
    again = np.zeros(len(ids), bool)
    again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (np.diff(order) < window)
    return ~again


def window_means(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Means of all windows; a text of fewer words is one window, one without words has the mean 0."""
    if len(values) <= window:
        return np.array([values.mean() if len(values) else 0.0])
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[window:] - total[:-window]) / window


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning; rows without id are not held out, and never learnt from either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of either label, those with the smallest hashes of their id; one text of an id."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    known = docs.select("doc_id").distinct()
    pick = [marked.filter(F.col("toxic") == y).join(known, "doc_id", "left_semi").orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    rows = pick[0].unionAll(pick[1]).collect()  # at most 2 * per_class narrow rows
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in rows], "doc_id long, toxic int")
    # an id in many rows gives the text with the smallest hash, chosen per task before anything is sent
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(least.alias("text")).collect()
    return sorted(((r["text"] or "", r["toxic"]) for r in texts), key=lambda x: zlib.crc32(x[0].encode()))


def fit(sample: list[tuple[str, int]], window: int = WINDOW, steps: int = 400, seed: int = 1) -> Model:
    """Train vectors and softmax jointly, with as many rounds over the sample as make ``steps`` steps; every fifth text
    of the sample is left out and sets the scale of the scores."""
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int64) for t, _ in sample]
    new = [fresh(t, window) for t in texts]
    grams, counts = array("i"), []
    for w in number or [""]:
        parts = subwords(w)
        counts.append(len(parts))
        grams.extend(parts)
    start, flat = np.concatenate([[0], np.cumsum(counts)]), np.frombuffer(grams, np.int32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    soft, bias = rng.normal(0, 1, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    sums = [np.full(BUCKETS, 1e-8, np.float32), 1e-8, 1e-8]  # of squared gradients (Adagrad)
    train = np.array([i for i in range(len(texts)) if i % 5 and len(texts[i])])

    def word_values() -> np.ndarray:
        return np.add.reduceat((vectors @ (soft[1] - soft[0]))[flat], start[:-1]) / np.diff(start)

    clean = np.concatenate([texts[i] for i in train if not labels[i]] or [np.zeros(1, np.int64)])

    def means(i: int, values: np.ndarray) -> np.ndarray:
        return window_means(np.where(new[i], values[texts[i]], usual), window)

    def step(windows: list[np.ndarray], sizes: np.ndarray, ys: np.ndarray, rate: float) -> None:
        """One gradient step of the softmax loss on averaged windows."""
        nonlocal soft, bias
        words = np.concatenate(windows)
        of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        n = start[words + 1] - start[words]
        cells = np.repeat(start[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        bucket, owner = flat[cells], np.repeat(of, n)
        share = np.repeat((1.0 / n / sizes[of]).astype(np.float32), n)  # of a word in its window, of an n-gram in its word
        mean = np.stack([np.bincount(owner, vectors[bucket, k] * share, len(windows)) for k in range(WIDTH)], 1)
        z = mean @ soft.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(ys)), ys] -= 1
        back = (p @ soft).astype(np.float32)
        uniq, inv = np.unique(bucket, return_inverse=True)
        grad = np.stack([np.bincount(inv, back[owner, k] * share, len(uniq)) for k in range(WIDTH)], 1).astype(np.float32)
        sums[0][uniq] += (grad ** 2).mean(1)
        vectors[uniq] -= rate * grad / np.sqrt(sums[0][uniq])[:, None]
        for j, g in ((1, (p.T @ mean) / len(ys)), (2, p.mean(0))):
            sums[j] += float((g ** 2).mean())
            change = (rate * g / np.sqrt(sums[j])).astype(np.float32)
            if j == 1:
                soft = soft - change
            else:
                bias = bias - change

    rounds = max(12, -(-steps * BATCH // max(len(train), 1)))
    for r in range(rounds):
        early = r < rounds // 5
        values = word_values()
        usual = float(values[clean].mean())
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            some, windows, sizes, ys = order[i:i + BATCH], [], [], []
            for d in some:
                t, random = texts[d], early
                spare = 4 if random else 1 - labels[d]
                places = [int(rng.integers(max(1, len(t) - window + 1))) for _ in range(spare)]
                places += [] if random else [int(means(d, values).argmax())]
                windows += [t[p:p + window][new[d][p:p + window]] for p in places]
                sizes += [min(window, len(t))] * len(places)
                ys += [labels[d]] * len(places)
            step(windows, np.array(sizes), np.array(ys), 0.15 if early else 0.08)
    values, gap = word_values(), float(bias[1] - bias[0])
    usual = float(values[clean].mean())
    check = [i for i in range(len(texts)) if i % 5 == 0 and len(texts[i])]
    if len(set(labels[check].tolist())) < 2:
        check = [i for i in range(len(texts)) if len(texts[i])]
    worst = np.array([means(i, values).max() for i in check]) + gap
    ys = labels[check]
    slope, shift = _scale(worst, ys)
    return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), gap, slope, shift, usual, float(np.median(worst[ys == 0])) - gap)


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through smoothed targets, both classes weighing the same."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        e, w = weight * (p - target), weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(e * x).sum(), e.sum()])
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 1e-3), b


class Lexicon:
    """The logit of every word met so far, by number."""

    def __init__(self, model: Model):
        self.model, self.number, self.values = model, {}, np.zeros(1024)

    def worst(self, text: str, window: int) -> float:
        words = WORD.findall(text.lower())
        if len(self.number) > REMEMBERED:
            self.number.clear()
        for w in {w for w in words if w not in self.number}:
            n = self.number[w] = len(self.number)
            if n >= len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values))])
            self.values[n] = self.model.word(w)
        if not words:
            return self.model.blank
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return float(window_means(np.where(fresh(ids, window), self.values[ids], self.model.usual), window).max())


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, text_key (hash of the text) and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                worst = np.array([words.worst(t or "", window) for t in some.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(shared.value.score(worst), pa.float64())], [key, "text_key", "score"])

    rows = docs.select(F.col(key).cast("bigint").alias(key), F.xxhash64(F.col(text)).alias("text_key"), text)
    return rows.mapInArrow(run, f"`{key}` long, text_key long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                worst = np.array([words.worst(t or "", window) for t in some.column(place).to_pylist()])
                yield some.filter(pa.array(shared.value.score(worst) < threshold))

    return docs.mapInArrow(run, docs.schema)
