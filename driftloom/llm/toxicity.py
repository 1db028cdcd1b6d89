"""Toxicity: a counterfactual-regularised linear classifier.

Features are hashed words and beginnings of words, present or not; follow-the-regularised-leader with
elastic-net penalties fits a logistic regression on a bounded sample (``SAMPLE``) of the labelled rows.
Texts of the sample that name a group are copied with the group swapped for another in all their sentences, and the
square of the score's change is penalised, so that a mention alone moves no score. The groups' terms are a parameter. Whole texts are scored in the
tasks that read them, without a shuffle.

Defined cases: an empty or null text gets the score of no evidence, and so does a text without letters; rows
without a label, with a null text or a null doc_id teach nothing; of several labels for a doc_id the highest counts;
of the rows that repeat a doc_id one teaches (that with the smallest features); if nothing or one class only can be learnt, all scores are the share of label 1 (0 without labels); rows
that repeat a doc_id are each scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .learning import Example, probabilities, train
from .letters import word_features

SAMPLE = 4000
PREFIXES, BITS = (4, 5, 6), 18
#: text that a worker looks at together
SLICE_BYTES = 256 << 10
THRESHOLD, SWAP_PENALTY = 0.7, 1.0
#: groups of terms that may stand for one another, in English, German, French and Spanish
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrants", "natives", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("christen", "muslime", "juden", "hindus", "buddhisten"), ("schwule", "lesben"), ("einwanderer", "flüchtlinge"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"), ("immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"), ("inmigrantes", "refugiados"),
)


def swapper(terms: tuple[tuple[str, ...], ...]) -> Callable[[str], str | None]:
    """text -> the text with each identity term replaced by the next of its (first) group; None if it has none."""
    following: dict[str, str] = {}
    for group in terms:
        for i, term in enumerate(group):
            following.setdefault(term, group[(i + 1) % len(group)])
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, following)) + r")\b", re.IGNORECASE)

    def swapped(text: str) -> str | None:
        new, n = pattern.subn(lambda m: following[m[0].lower()], text)
        return new if n else None

    return swapped if following else lambda text: None


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        feature, owner = word_features(texts, PREFIXES, BITS)
        some = self.weights[feature] != 0  # few: the penalty leaves most weights at zero
        pairs = np.unique(owner[some] << BITS | feature[some])
        total = np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=len(texts)) if len(pairs) else np.zeros(len(texts))
        return probabilities((total + self.bias)[:, None])[:, 0]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def examples(docs: DataFrame, labels: DataFrame, most: int, terms: tuple[tuple[str, ...], ...]) -> list[Example]:
    """A bounded sample of the labelled rows: features are made where the rows are."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.select(F.col("doc_id").alias("picked"), "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "picked").limit(most).drop("h")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("doc_id", "toxic", "text")

    def features_of(texts: list[str]) -> list[bytes]:
        feature, owner = word_features(texts, PREFIXES, BITS)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.unique(feature[a:b]).astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swapped = swapper(terms)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = batch.column("text").to_pylist()
                others = [swapped(t) for t in texts]
                swaps = features_of([t or "" for t in others])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("toxic").cast(pa.int32()),
                        pa.array(features_of(texts), pa.binary()),
                        pa.array([s if o is not None else None for s, o in zip(swaps, others, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "toxic", "feature", "other"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(make, f"doc_id {kind}, toxic int, feature binary, other binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("feature", "other", "toxic")).alias("e"))  # as many rows as were picked, at most
    got = one.select("doc_id", "e.toxic", "e.feature", "e.other").toArrow().to_pylist()
    got.sort(key=lambda r: r["doc_id"])
    ids = lambda x: np.frombuffer(x, "<i4")
    ones = lambda x: np.ones(len(x) // 4)
    return [
        Example(r["toxic"], ids(r["feature"]), ones(r["feature"]), *((ids(r["other"]), ones(r["other"])) if r["other"] is not None else (None, None)))
        for r in got
    ]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap_penalty: float = SWAP_PENALTY, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    made = examples(docs, labels, sample, terms)
    ones = sum(e.label for e in made)
    if not 0 < ones < len(made):
        share = min(max(ones / max(1, len(made)), 0.0), 1.0)
        return Model(np.zeros(1 << BITS), 500.0 if share == 1 else -500.0)
    # features of few rows, and weights that many rows don't ask for, are noise
    least, l1 = max(3, len(made) // 500), max(2.0, len(made) / 500)
    seen = np.bincount(np.concatenate([e.index for e in made]), minlength=1 << BITS)
    for e in made:
        keep = seen[e.index] >= least
        e.index, e.value = e.index[keep], e.value[keep]
        if e.other_index is not None:
            keep = seen[e.other_index] >= least
            e.other_index, e.other_value = e.other_index[keep], e.other_value[keep]
    importance = [len(made) / (2 * (len(made) - ones)), len(made) / (2 * ones)]
    model = train(made, 1 << BITS, 2, epochs=8, swap_penalty=swap_penalty, importance=importance, alpha=0.5, l1=l1, l2=0.5)
    weights, bias = model.final()
    return Model(weights[:, 0], float(bias[0]))


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


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, labels, sample))
