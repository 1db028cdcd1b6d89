"""Content-addressed storage: presence, choice of a store, what to save, and archives (stores themselves: ``sources.contents``)."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: parts of a stored directory at most
PARTS = 16
#: bytes of files of one archive part, about, if parts are made by size; bytes of a chunk of an archive
PART_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20


def store_choice(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """version, n_stores, stores (all that hold it, the last by name first), storage_name: the first of them."""
    held = stored.select("version", "storage_name").distinct()
    return versions.select("version").distinct().join(held, "version").groupBy("version").agg(F.count("*").alias("n_stores"), F.sort_array(F.collect_set("storage_name"), asc=False).alias("stores"), F.max("storage_name").alias("storage_name"))


def one_path_each(paths: DataFrame) -> DataFrame:
    """version, path, copies: of paths with equal content the first by name."""
    return paths.groupBy("version").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def save_plan(paths: DataFrame, stored: DataFrame, storage_name: str) -> DataFrame:
    """version, path of what the store doesn't hold yet, each content once."""
    there = stored.filter(F.col("storage_name") == storage_name).select("version").distinct()
    return one_path_each(paths.filter("version is not null")).join(there, "version", "left_anti").select("version", "path")


def archive_parts(files: DataFrame, by: list[str], order: str, most: int = PARTS) -> DataFrame:
    """part: round robin over a directory's files, at most so many parts.

    Files of a directory are numbered in order, so a directory's rows (not contents) meet in one task.
    """
    w = Window.partitionBy(*by)
    return files.withColumn("part", ((F.row_number().over(w.orderBy(order)) - 1) % F.least(F.count("*").over(w), F.lit(most))).cast("long"))


def archive_runs(files: DataFrame, by: list[str], name: str, size: str, most_bytes: int = PART_BYTES) -> DataFrame:
    """by, name, part: runs of a directory's files in order of name, each of about so many bytes at most (or one file).

    A part is known from the sizes of the files before, whose sum runs on through the directory; sizes only are sorted.
    """
    order = Window.partitionBy(*by).orderBy(name)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select(*by, name, size).withColumn("part", F.floor(before / most_bytes).cast("long")).drop(size)


def archive(files: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, part, chunk, data: a zip of the files (name, content) of each (by, part), names in order, as chunks of some MB.

    A task writes the parts that come to it as streams of files sorted by name: it holds a batch of files and a chunk.
    """
    keys = [*by, "part"]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keys)
    ordered = files.select(*keys, name, "content").repartition(*keys).sortWithinPartitions(*keys, name)
    return ordered.mapInArrow(zipped(keys, name), f"{kinds}, chunk int, data binary")


class _Chunks(io.RawIOBase):
    """What is written, cut into chunks that are taken out as soon as they are full."""

    def __init__(self, size: int):
        self.size, self.held, self.full = size, bytearray(), []

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        view = memoryview(data).cast("B")
        for at in range(0, len(view), self.size):
            self.held += view[at : at + self.size]
            while len(self.held) >= self.size:
                self.full.append(bytes(self.held[: self.size]))
                del self.held[: self.size]
        return len(view)

    def taken(self, end: bool = False) -> list[bytes]:
        out, self.full = self.full, []
        if end and self.held:
            out.append(bytes(self.held))
            self.held = bytearray()
        return out


def zipped(keys: list[str], name: str, chunk_bytes: int = CHUNK_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of sorted (keys, name, content) to (keys, chunk, data): a zip for each run of equal keys."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        import pyarrow as pa

        key, out, archive_, n, types = None, None, None, 0, []

        def batch(chunks: list[bytes], first: int) -> Iterator[pa.RecordBatch]:
            for i, data in enumerate(chunks):
                columns = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([first + i], pa.int32()), pa.array([data], pa.binary())], [*keys, "chunk", "data"])

        for rows in batches:
            types = [rows.column(c).type for c in keys]
            columns = [rows.column(c).to_pylist() for c in keys]
            for i in range(rows.num_rows):
                here = tuple(c[i] for c in columns)
                if archive_ is None or here != key:
                    if archive_ is not None:
                        archive_.close()
                        yield from batch(out.taken(end=True), n)
                    key, n, out = here, 0, _Chunks(chunk_bytes)
                    archive_ = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                with archive_.open(zipfile.ZipInfo(rows.column(name)[i].as_py()), "w") as entry:
                    content = rows.column("content")[i].as_buffer() if rows.column("content")[i].is_valid else b""
                    view = memoryview(content)
                    for at in range(0, len(view), chunk_bytes):
                        entry.write(view[at : at + chunk_bytes])
                chunks = out.taken()
                yield from batch(chunks, n)
                n += len(chunks)
        if archive_ is not None:
            archive_.close()
            yield from batch(out.taken(end=True), n)

    return stream


def extract(archives: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, part, name, content of every file in the archives (by, part, chunk, data). A task holds one part, and yields a file at a time."""
    keys = [*by, "part"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        import pyarrow as pa

        key, held, types = None, io.BytesIO(), []

        def contents() -> Iterator[pa.RecordBatch]:
            with zipfile.ZipFile(held) as z:
                for entry in z.namelist():
                    columns = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([entry], pa.string()), pa.array([z.read(entry)], pa.binary())], [*keys, name, "content"])

        for rows in batches:
            types = [rows.column(c).type for c in keys]
            for *here, data in zip(*(rows.column(c).to_pylist() for c in (*keys, "data")), strict=True):
                if key is not None and tuple(here) != key:
                    yield from contents()
                    held = io.BytesIO()
                key = tuple(here)
                held.write(data)
        if key is not None:
            yield from contents()

    kinds = ", ".join(f"`{c}` {archives.schema[c].dataType.simpleString()}" for c in keys)
    ordered = archives.select(*keys, "chunk", "data").repartition(*keys).sortWithinPartitions(*keys, "chunk")
    return ordered.mapInArrow(stream, f"{kinds}, `{name}` string, content binary")


#: lines around the entries that are managed for the user
SECTION_START, SECTION_END = "# --- managed entries: start ---", "# --- managed entries: end ---"


def merged_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sorted union of two lists of entries (one column, entry)."""
    return old.select("entry").union(new.select("entry")).distinct().orderBy("entry")


def with_entries(lines: DataFrame, new: DataFrame) -> DataFrame:
    """file, pos, line: ignore lists (file, pos, line) whose managed section has the entries (file, entry) too.

    The section holds the sorted union of its old and new entries; lines before and after it are kept; a file without a
    section, or without lines, gets one at its end. A second section, or an end before its start, or none, is an error.
    """
    order = Window.partitionBy("file").orderBy("pos")
    starts, ends = F.count_if(F.col("line") == SECTION_START), F.count_if(F.col("line") == SECTION_END)
    placed = lines.withColumn("starts", starts.over(order)).withColumn("ends", ends.over(order))
    open_ = F.max("starts") > F.max("ends")
    broken = placed.groupBy("file").agg((F.bool_or((F.col("starts") > 1) | (F.col("ends") > F.col("starts"))) | open_).alias("broken"))
    part = F.when(F.col("starts") == 0, 0).when(F.col("ends") == 0, 1).otherwise(2)
    placed = placed.select("file", "pos", "line", part.alias("part")).filter((F.col("line") != SECTION_START) & (F.col("line") != SECTION_END))
    old = placed.filter("part = 1").select("file", F.col("line").alias("entry"))
    files = lines.select("file").union(new.select("file")).distinct()
    error = F.raise_error(F.concat(F.lit("the managed section is malformed in "), "file"))
    marks = files.join(broken, "file", "left").select("file", "broken", F.explode(F.array(F.lit(0.5), F.lit(1.5))).alias("part"))
    marks = marks.select("file", "part", F.lit(0).cast("long"), F.when(F.col("broken"), error).when(F.col("part") < 1, SECTION_START).otherwise(SECTION_END))
    kept = placed.filter("part <> 1").select("file", F.col("part").cast("double").alias("part"), "pos", "line")
    entries = old.union(new.select("file", "entry")).distinct().select("file", F.lit(1.0).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("entry").alias("line"))
    out = kept.union(entries).union(marks)
    return out.select("file", F.row_number().over(Window.partitionBy("file").orderBy("part", "pos", "line")).alias("pos"), "line")
