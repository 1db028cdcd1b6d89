"""Quality: supervised subword embeddings.

A text is the average of learnt vectors of its hashed words, pairs of words and character n-grams (of words with their edges),
followed by a softmax over both labels; numpy's stochastic gradient descent fits vectors and output on a bounded sample (``SAMPLE``) of the
labelled rows, a fifth of which sets the scores' temperature. As the average and the output are linear, a feature counts in a score
by one number, its vector's share of the difference of both outputs: whole texts are scored from a table of these, in
the tasks that read them, without a shuffle.

Defined cases: a null text counts as empty; a text without words gets the score of no evidence, and so do all rows if
nothing or one label only can be learnt (the share of label 1, 0 without labels); rows without a label (0 or 1), with a null text or a null
doc_id teach nothing; of several labels for a doc_id the highest counts; of the rows that repeat a doc_id one teaches (that with the
smallest features); rows that repeat a doc_id are each scored; a null doc_id is not held out; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, slices
from .learning import probabilities, temperature
from .letters import CODE_BASE, SPREAD, code_points

SAMPLE = 4000
ORDERS, BITS, WIDTH, REPEATED = (3, 4, 5), 18, 10, 1 << 63
EPOCHS, RATE, SEED = 6, 3.0, 12
#: text that a worker looks at together; characters whose n-grams are made together
SLICE_BYTES, BLOCK = 256 << 10, 1 << 15
THRESHOLD = 0.7


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of each word, each pair of words and each n-gram of a word with its edges, some at a time."""
    points, at = code_points(texts)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(space, np.uint32(32), points)
    bits, n = np.uint64(64 - BITS), len(points)
    change = np.flatnonzero(np.diff(space))  # the first character is an edge, and so is the last
    starts, ends = change[::2] + 1, change[1::2] + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64)) * powers(CODE_BASE, n), dtype=np.uint64, out=sums[1:])
    inverse = powers(np.uint64(pow(int(CODE_BASE), -1, 2**64)), n + 1)
    words = mix64((sums[ends] - sums[starts]) * inverse[starts])
    owner = np.searchsorted(at, starts, side="right") - 1
    yield (words >> bits).astype(np.int64), owner
    # pairs of words; a word that follows itself is a feature of its own, whatever the word
    pairs = np.where(words[1:] == words[:-1], np.uint64(REPEATED), mix64(words[:-1] * CODE_BASE + words[1:])) >> bits
    same = owner[1:] == owner[:-1]
    yield pairs[same].astype(np.int64), owner[1:][same]
    edges = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    for low in range(0, n, BLOCK):
        some = points[low : low + BLOCK + ORDERS[-1] - 1].astype(np.uint64)
        h = np.zeros(min(BLOCK, n - low), np.uint64)
        text = np.searchsorted(at, np.arange(low, low + len(h)), side="right") - 1
        for k in range(1, ORDERS[-1] + 1):
            m = min(len(h), len(some) - k + 1)
            h = h[:m] * CODE_BASE + some[k - 1 : k - 1 + m]
            if k in ORDERS:  # no edge inside
                first = np.arange(low, low + m)
                ok = edges[first + k - 1] == edges[first + 1]
                yield (((h[ok] ^ (h[ok] >> np.uint64(29))) * SPREAD) >> bits).astype(np.int64), text[:m][ok]


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, how often) of each text."""
    parts = list(features(texts))
    feature, owner = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    both, n = np.unique(owner << BITS | feature, return_counts=True)
    cuts = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
    return [(both[a:b] & ((1 << BITS) - 1), n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Example:
    label: int
    index: np.ndarray
    weight: np.ndarray  # adds up to 1


class Embeddings:
    """Vectors by feature and softmax output over two labels, moved example by example."""

    def __init__(self, rng: np.random.Generator):
        self.vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH))
        self.output, self.bias = np.zeros((WIDTH, 2)), np.zeros(2)

    def learn(self, e: Example, rate: float, importance: float) -> None:
        rows = self.vectors[e.index]
        average = e.weight @ rows
        gradient = importance * probabilities(average @ self.output + self.bias)
        gradient[e.label] -= importance
        back = self.output @ gradient
        self.output -= rate * np.outer(average, gradient)
        self.bias -= rate * gradient
        self.vectors[e.index] = rows - rate * e.weight[:, None] * back[None, :]

    def by_feature(self) -> tuple[np.ndarray, float]:
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def evidence(self, index: np.ndarray, weight: np.ndarray) -> float:
        return float(weight @ self.weights[index]) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for feature, owner in features(texts):
            total += np.bincount(owner, weights=self.weights[feature], minlength=len(texts))
            n += np.bincount(owner, minlength=len(texts))
        return probabilities((total / np.maximum(n, 1) + self.bias)[:, None])[:, 0]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def examples(docs: DataFrame, labels: DataFrame, most: int) -> list[Example]:
    """A bounded sample of the labelled rows: features are made where the rows are."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    picked = known.select(F.col("doc_id").alias("picked"), "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "picked").limit(most).drop("h")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("doc_id", "label", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                made = counted(batch.column("text").to_pylist())
                packed = [pa.array([x[i].astype("<i4").tobytes() for x in made], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), *packed], ["doc_id", "label", "feature", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(make, f"doc_id {kind}, label int, feature binary, n binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("feature", "n", "label")).alias("e"))  # as many rows as were picked, at most
    got = one.select("doc_id", "e.*").toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    ids, counts = ([np.frombuffer(r[c], "<i4") for r in got] for c in ("feature", "n"))
    return [Example(r["label"], i, n / max(1, n.sum())) for r, i, n in zip(got, ids, counts, strict=True)]


def trained(made: list[Example], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fits four fifths of the examples and sets the temperature on the others. Both labels weigh the same."""
    ones = sum(e.label for e in made)
    if not 0 < ones < len(made):
        share = ones / max(1, len(made))
        return Model(np.zeros(1 << BITS), 500.0 if share == 1 else -500.0)
    importance = [len(made) / (2 * (len(made) - ones)), len(made) / (2 * ones)]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(made))
    test, learn = order[: len(made) // 5], order[len(made) // 5 :]
    net, steps = Embeddings(rng), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            net.learn(made[i], rate * (1 - steps / (epochs * len(learn))), importance[made[i].label])
            steps += 1
    model = Model(*net.by_feature())
    evidence = np.array([[model.evidence(made[i].index, made[i].weight)] for i in test])
    t = temperature(evidence, np.array([made[i].label for i in test])) if len(test) else 1.0
    return Model(model.weights / t, model.bias / t)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return trained(examples(docs, labels, sample))


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                scores = m.scores([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, labels, sample))
