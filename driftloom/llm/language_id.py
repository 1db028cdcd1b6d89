"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of letters and word edges; inverse document frequencies count all labelled
rows to learn from. Follow-the-regularised-leader with elastic-net penalties fits a bounded sample of
them (``SAMPLE`` rows, those with the smallest hash of doc_id); a fifth of the sample sets the
temperature. Whole texts are then scored in the tasks that read them, without a shuffle.

Defined cases: ``und`` with score 0 for a text that is null or has no letter, and for all rows if nothing
can be learnt; a null lang teaches nothing; ties go to the first language in order of code point; rows
that repeat a doc_id are each predicted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .learning import Example, probabilities, temperature, train
from .letters import compacted, letter_counts, ngram_blocks

SAMPLE = 3000
ORDERS, BITS = 3, 16
#: text that a worker looks at together: its arrays then take some MB, more only for a single longer text
SLICE_BYTES, SLICE_ROWS = 128 << 10, 64
SCALE = 50.0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x language, with inverse document frequencies and temperature inside
    bias: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text and language, and each text's number of letters."""
        points, at = compacted(texts)
        n, languages = len(texts), self.weights.shape[1]
        total, out = np.zeros(n), np.zeros((n, languages))
        for feature, owner in ngram_blocks(points, at, ORDERS, BITS):
            total += np.bincount(owner, minlength=n)
            for c in range(languages):
                out[:, c] += np.bincount(owner, weights=self.weights[feature, c], minlength=n)
        return out * (SCALE / np.maximum(total, 1))[:, None] + self.bias, letter_counts(points, at)

    def named(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Predicted language and its score, ``und`` and 0 without letters."""
        scores, letters = self.scores(texts)
        p = probabilities(scores) if scores.shape[1] > 1 else np.ones_like(scores)
        names = [self.languages[c] if k else "und" for c, k in zip(p.argmax(axis=1), letters, strict=True)]
        return names, np.where(letters > 0, p.max(axis=1), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each feature (its number is bounded by the hash), and documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        marks = np.zeros((SLICE_ROWS, 1 << BITS), np.uint8)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES, SLICE_ROWS):
                texts = batch.column("text").to_pylist()
                for feature, owner in ngram_blocks(*compacted(texts), ORDERS, BITS):
                    marks[owner, feature] = 1
                seen += marks[: len(texts)].sum(axis=0, dtype=np.uint8)  # 64 rows at most
                marks[: len(texts)] = 0
                n += len(texts)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(seen[some], n), pa.int64())})

    table = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out, index, n = np.zeros((1 << BITS) + 1, np.int64), table.column("feature").to_numpy(), table.column("n").to_numpy()
    out[index] = n
    return out[:-1], int(out[-1])


def examples(docs: DataFrame, most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, feature, count) of a bounded sample; features are made where the rows are."""
    order = ["h", "doc_id", "lang", "digest"]
    keyed = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("digest"))
    last = keyed.orderBy(*order).limit(most).agg(F.max(F.struct(*order)).alias("last")).select("last.*").collect()[0]
    # the rows up to the last of the sample, however often its doc_id is repeated
    here = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", F.xxhash64("text").alias("digest"))
    upto = F.struct(*[F.lit(last[c]).cast(docs.schema["doc_id"].dataType if c == "doc_id" else "string" if c == "lang" else "long").alias(c) for c in order])
    rows = docs.filter(here <= upto).select("doc_id", "lang", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES, SLICE_ROWS):
                texts = batch.column("text").to_pylist()
                counts = np.zeros((len(texts), 1 << BITS), np.int32)
                for feature, owner in ngram_blocks(*compacted(texts), ORDERS, BITS):
                    np.add.at(counts, (owner, feature), 1)
                parts = [(some := np.flatnonzero(row), row[some]) for row in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("lang"), pa.array([p[0].astype("<i4").tobytes() for p in parts], pa.binary()), pa.array([p[1].astype("<i4").tobytes() for p in parts], pa.binary())],
                    ["doc_id", "lang", "feature", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(make, f"doc_id {kind}, lang string, feature binary, n binary").limit(most).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["feature"], r["n"]))
    return [(r["lang"], np.frombuffer(r["feature"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in got[:most]]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = examples(known, sample)
    languages = sorted({lang for lang, _, _ in rows}, key=lambda x: x.encode())
    if not languages:
        return None
    frequency, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    made = [Example(languages.index(lang), f, SCALE * c / max(1, c.sum()) * idf[f]) for lang, f, c in rows]
    if len(languages) == 1:
        return Model(languages, np.zeros((1 << BITS, 1)), np.zeros(1))
    test, learn = made[::5], [e for i, e in enumerate(made) if i % 5]
    model = train(learn or made, 1 << BITS, max(3, len(languages)), epochs=3, alpha=0.3, l1=0.3, l2=0.1)
    weights, bias = model.final()
    weights, bias = weights[:, : len(languages)], bias[: len(languages)]
    scores = np.array([e.value @ weights[e.index] + bias for e in test])
    t = temperature(scores, np.array([e.label for e in test]))
    return Model(languages, weights * idf[:, None] / t, bias / t)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES, SLICE_ROWS):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                if m is None:
                    names, best = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    names, best = m.named(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows with a predicted language (not ``und``), with all their columns; those with letters if nothing can be learnt."""
    model_ = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES, SLICE_ROWS):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                keep = [name != "und" for name in m.named(texts)[0]] if m is not None else letter_counts(*compacted(texts)) > 0
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, sample))
