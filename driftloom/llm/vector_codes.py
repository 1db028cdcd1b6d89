"""Vector code compression: product codes by delta-maintained Lloyd rounds on integer vectors.

Components become integers, floor(SCALE * x), and vectors are cut into equal consecutive parts. Each part position has a
codebook, which begins with that part of the first kept vectors in order of vec_id. A round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the componentwise
floor of its parts' mean; entries without parts stay. Assignments are kept in a written table beside the vectors, and
sums and counts by entry run on: a round only shuffles what parts with a new assignment add to their new entry
and take from their old one, summed up in the tasks before. What the driver holds are codebooks, sums and counts, whose
size depends on the parameters and the vectors' length alone.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; all other vectors must have
one length, a multiple of the number of parts, and components whose scaled value lies within +-2**40 (else an error); a
null vec_id comes last; rows that share a vec_id come in the order of their components and are all coded; with
fewer vectors than entries the codebooks are as short; labels are compared as they are, nulls together; without
kept vectors there are no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_folder, new_folder, settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: scaled components beyond are an error; within SAFE a distance of 2**15 components fits 64 bits
MOST, SAFE = 1 << 40, 1 << 23
#: vectors that a worker looks at together
BLOCK = 2048
BROADCAST_LABELS = 1 << 16


@dataclass
class Codebooks:
    """entries: part x entry x position; sums and counts of the parts assigned last, Python integers so that they stay exact."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of_first(cls, vectors: list[list[int]], parts: int) -> Codebooks:
        entries = np.array(vectors, dtype=object).reshape(len(vectors), parts, -1).transpose(1, 0, 2)
        return cls(entries, np.full(entries.shape, 0, object), np.full(entries.shape[:2], 0, object))

    def moved(self, deltas: list) -> None:
        """Adds what parts changed by (part, entry, position, amount; position -1: count), and moves the entries."""
        for part, entry, position, amount in deltas:
            if position < 0:
                self.counts[part, entry] += int(amount)
            else:
                self.sums[part, entry, position] += int(amount)
        for part, entry in zip(*np.nonzero(self.counts), strict=True):
            self.entries[part, entry] = self.sums[part, entry] // self.counts[part, entry]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel()).encode()).hexdigest()


def integers(rows: pa.Array) -> np.ndarray:
    """Vectors of one length from a list array."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, by vector and part."""
    parts, _, width = entries.shape
    cut = vectors.reshape(len(vectors), parts, width)
    if len(cut) and max(np.abs(cut).max(initial=0), max((abs(int(x)) for x in entries.ravel()), default=0)) >= SAFE:
        cut = cut.astype(object)
    else:
        entries = entries.astype(np.int64)
    distance = np.stack([((cut - entries[:, e][None]) ** 2).sum(axis=2) for e in range(entries.shape[1])], axis=2)
    code = distance.argmin(axis=2)
    return code, np.take_along_axis(distance, code[:, :, None], axis=2)[:, :, 0]


def kept_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, ints of the rows that are kept."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    numbers = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("numbers"))
    fine = numbers.filter(F.col("numbers").isNotNull() & ~F.exists("numbers", bad))
    scaled = lambda x: F.when(F.abs(x * scale) <= MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return fine.select("vec_id", "label", F.transform("numbers", scaled).alias("ints"))


def assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state with new codes; changed: parts whose code is new, as bits."""
    books_ = state.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books_.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                code = nearest(integers(batch.column("ints")), entries)[0].astype(np.uint8)
                old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(code.shape)
                changed = ((code != old) << np.arange(code.shape[1])).sum(axis=1)
                columns = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "ints": batch.column("ints"), "before": batch.column("code")}
                columns |= {"code": pa.array([x.tobytes() for x in code], pa.binary()), "changed": pa.array(changed, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    names = [f for f in state.schema.fields if f.name in ("vec_id", "label")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    return state.select("vec_id", "label", "ints", "code").mapInArrow(run, f"{kinds}, ints array<bigint>, before binary, code binary, changed long")


def contributions(state: DataFrame, parts: int, none: int) -> DataFrame:
    """part, entry, position, amount: what changed parts add to their new entries and take from their old ones, by task. none: the
    code of a part that had no entry yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                cut = integers(batch.column("ints")).reshape(batch.num_rows, parts, -1)
                new, old = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, parts) for c in ("code", "before"))
                for part in range(parts):
                    differs = new[:, part] != old[:, part]
                    for codes, sign in ((new, 1), (old, -1)):
                        for entry in np.unique(codes[differs, part]):
                            if entry == none:
                                continue
                            mine = differs & (codes[:, part] == entry)
                            for position, x in enumerate([int(mine.sum()), *cut[mine, part].sum(axis=0).tolist()], -1):
                                key = (part, int(entry), position)
                                total[key] = total.get(key, 0) + sign * x
        keys = [k for k, x in total.items() if x]
        columns = {name: pa.array([k[i] for k in keys], pa.int32()) for i, name in enumerate(("part", "entry", "position"))}
        yield pa.RecordBatch.from_pydict(columns | {"amount": pa.array([str(total[k]) for k in keys], pa.string())})

    some = state.filter("changed <> 0").select("ints", "before", "code")
    made = some.mapInArrow(run, "part int, entry int, position int, amount string")
    return made.groupBy("part", "entry", "position").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code as bytes, error of every kept vector; the codebooks), None for the codebooks if nothing is kept."""
    if not 1 <= entries <= 255:
        raise ValueError("a code has one byte: 1 to 255 entries")
    spark = vectors.sparkSession
    none = b"\xff" * parts
    written = new_folder(spark, "vectors")
    kept_vectors(vectors, scale).withColumn("code", F.lit(none)).write.parquet(written)
    state = spark.read.parquet(written)
    lengths = state.agg(F.min(F.size("ints")), F.max(F.size("ints"))).first()
    first = state.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return state.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")), None
    if lengths[0] != lengths[1] or lengths[0] % parts or not lengths[0]:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; there are {lengths[0]} to {lengths[1]}")
    books = Codebooks.of_first([r["ints"] for r in first], parts)
    for _ in range(rounds):
        before, written = written, new_folder(spark, "assigned")
        assigned(state, books).write.parquet(written)
        delete_folder(spark, before)
        state = spark.read.parquet(written)
        books.moved([tuple(r) for r in contributions(state, parts, 255).collect()])  # at most parts x entries x (width + 1) rows
    books_ = spark.sparkContext.broadcast(books.entries)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                code, distance = nearest(integers(batch.column("ints")), books_.value)
                columns = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([x.astype(np.uint8).tobytes() for x in code], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns | {"error": pa.array([int(x) for x in distance.sum(axis=1)], pa.int64())})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields if f.name in ("vec_id", "label"))
    done = settle(state.select("vec_id", "label", "ints").mapInArrow(finish, f"{kinds}, code binary, error long"), "codes")
    delete_folder(spark, written)
    return done, books


def code_digests(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    done, books = compress(vectors, **options)
    by_label = settle(done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    joined = done.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
