"""What the training-data operators share: tables, intermediate tables, word spans and hashes.

White space is the class ``[\\x20\\x09-\\x0D]`` throughout; a word is a maximal run of other characters.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts stay small, so that a Python worker holds a few MB of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_run_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is configured."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
    return spark.sparkContext.getCheckpointDir()


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside go to one folder, which the caller deletes when the result has been written."""
    folder = f"{shared_dir(spark)}/driftloom-run-{uuid.uuid4().hex}"
    _run_folders.append(folder)
    try:
        yield folder
    finally:
        _run_folders.remove(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that doesn't exist yet, for an intermediate table."""
    return f"{_run_folders[-1] if _run_folders else shared_dir(spark)}/driftloom-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder as Parquet and read it back: short lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with more underscores if columns of the table are called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, so that they can be told apart whatever their doc_ids; the number's column."""
    row = free_name(docs, "row_")
    return settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def row_column(row: str | None) -> list[Column]:
    """The column that holds rows' numbers, if there is one, as the operators call it (row_)."""
    return [F.col(row).alias("row_")] if row else []


def text_of(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.Generator(np.random.PCG64(20240601))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE, BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: so many powers are kept in a worker; bytes hashed at a time
KEPT_POWERS, SPAN_BLOCK = 1 << 17, 1 << 16
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64. Short ones are kept for the next call."""
    if n <= KEPT_POWERS:
        return _powers(int(base), KEPT_POWERS)[:n]
    return _powers.__wrapped__(int(base), n)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs have equal hashes wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), dtype=np.uint64, out=sums[1:])
    back = powers(BASE_INVERSE, n + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that follow one another, a block of them at a time, so that memory beside the result
    stays at some MB (more only for a single longer span)."""
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + SPAN_BLOCK, side="right")))
        a, b = starts[k], ends[m - 1]
        out[k:m] = run_hashes(BYTE_CODES[data[a:b]], starts[k:m] - a, ends[k:m] - a)
        k = m
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of some texts in one array, and the texts' offsets in it; null is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some texts, as spans of one UTF-8 buffer, with 64-bit hashes.

    data: bytes of all texts; text_at: offsets of the texts in it; starts, ends: the words' spans;
    hashes: one for each word; word_at: offsets of the texts among the words.
    """

    def __init__(self, texts: pa.Array):
        data, self.text_at = bytes_of(texts)
        self.data = data
        inside = ~_IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.text_at[:-1][self.text_at[:-1] < len(data)]
        first[heads] = inside[heads]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = self.text_at[1:][self.text_at[1:] > 0] - 1
        last[tails] = inside[tails]
        self.ends = np.flatnonzero(last) + 1
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.word_at = np.searchsorted(self.starts, self.text_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 512 << 10, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about so many bytes of text each and so many rows at most, whole rows always."""
    sizes = batch.column(column).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]) if len(sizes) else np.zeros(0)
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (total + n > most_bytes or i - at == most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def runs_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position in the text) of every run of k words that lies in one text."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(words.word_at) - 1), words.counts())
    starts = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    return run_hashes(words.hashes, starts, starts + k), text[starts], starts - words.word_at[text[starts]]


#: ids that are broadcast at most to pick rows, 8 bytes each; more are joined by shuffle
BROADCAST_IDS = 1 << 20


def with_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the ids (one column, distinct): without moving the rows if the ids are few enough."""
    ids = ids.toDF(name := free_name(df, "id_"))
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(name), "left_semi")


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is null or not among the ids (one column, distinct)."""
    ids = ids.toDF(name := free_name(df, "id_")).filter(F.col(name).isNotNull())
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(name), "left_anti")


def joined_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """For each text its kept words, with one space between."""
    data = words.data.copy()
    edges = np.zeros(len(data) + 1, np.int8)
    edges[words.starts[keep]] += 1
    edges[words.ends[keep]] -= 1
    chosen = np.cumsum(edges[:-1], dtype=np.int8) > 0
    owner = np.searchsorted(words.word_at, np.flatnonzero(keep), side="right") - 1
    between = words.ends[keep][:-1][owner[1:] == owner[:-1]] if len(owner) else np.zeros(0, np.int64)
    data[between] = 32
    chosen[between] = True
    at = np.concatenate([[0], np.cumsum(chosen)])[words.text_at]
    out = data[chosen].tobytes()
    return [out[a:b] for a, b in zip(at, at[1:], strict=False)]
