"""Scan of files by a path pattern: each ``*`` is a dimension of the index.

Directory parts are literal or ``*``; the file part is literal or ``*.suffix``, whose index part is the name up to its
first dot. A final ``/`` asks for directories. Names that begin with a dot or end with ``.hash`` are skipped.
Folders are listed in tasks, a level of the tree in each round; empty files and empty directories are listed too.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import HASH_SUFFIX, META_SUFFIX
from .roots import FOLDER
from .tables import dealt, settle

#: bytes of a file that are hashed at a time
CHUNK = 8 << 20
ENTRY = "relative string, directory boolean, mtime timestamp, length long"


def compiled(pattern: str) -> tuple[str, int]:
    """Regular expression over root-relative paths with a group for each dimension, and the rank."""
    directory = pattern.endswith("/")
    parts = pattern.rstrip("/").split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1 and not directory
        if "*" not in part:
            out.append(re.escape(part))
        elif part == "*" and not last:
            out.append(r"([^/.][^/]*)")
        elif last and part.startswith("*.") and part.count("*") == 1:
            out.append(r"([^/.]+)(?:\.[^/]*)?" + re.escape(part[1:]))
        else:
            raise ValueError(f"a wildcard is * for a directory and *.suffix for files, not {part}")
    return "^" + "/".join(out) + ("/$" if directory else "$"), pattern.count("*")


def entries(spark: SparkSession, root: str, tops: DataFrame | None = None) -> DataFrame:
    """relative, directory, mtime, length of all that lies under a root, but for hidden and side files. A directory's
    relative path ends with ``/`` and its length is 0. The root itself is the directory with an empty path. With tops (relative), what lies
    under these directories, and they themselves, as far as they are there."""
    from .roots import filesystem

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        system, base = filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/")))
                directory = [x.type == FileType.Directory for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([folder + x.base_name + ("/" if d else "") for x, d in zip(found, directory, strict=True)], pa.string()),
                        pa.array(directory, pa.bool_()),
                        pa.array([(x.mtime_ns or 0) // 1000 for x in found], pa.timestamp("us", tz="UTC")),
                        pa.array([x.size or 0 for x in found], pa.int64()),
                    ],
                    ["relative", "directory", "mtime", "length"],
                )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        system, base = filesystem(root)
        for batch in batches:
            found = [(name, x) for name in batch.column(0).to_pylist() if (x := system.get_file_info(f"{base}/{name}".rstrip("/"))).type == FileType.Directory]
            times = pa.array([(x.mtime_ns or 0) // 1000 for _, x in found], pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([True] * len(found), pa.bool_()), times, pa.array([0] * len(found), pa.int64())], ["relative", "directory", "mtime", "length"])

    if tops is None:
        system, base = filesystem(root)
        listed = spark.createDataFrame([("", True, system.get_file_info(base).mtime, 0)], ENTRY)
        frontier = listed
    else:
        listed = settle(dealt(tops.select("relative"), "relative").distinct().mapInArrow(find, ENTRY))
        frontier = listed
    name = F.element_at(F.split(F.rtrim(F.col("relative"), F.lit("/")), "/"), -1)
    ours = ~(name.startswith(".") | F.lower("relative").endswith(HASH_SUFFIX) | F.lower("relative").endswith(META_SUFFIX))
    while not frontier.isEmpty():
        found = settle(dealt(frontier.select("relative"), "relative").mapInArrow(look, ENTRY).filter(ours))
        listed, frontier = listed.union(found), found.filter("directory")
    return listed


def index_of(pattern: str, relative: Column) -> Column:
    """Index of a path under a pattern; null if it doesn't match."""
    regex, n = compiled(pattern)
    index = F.array(*[F.regexp_extract(relative, regex, i + 1) for i in range(n)]).cast("array<string>")
    return F.when(F.regexp_like(relative, F.lit(regex)), index)


def scan(listed: DataFrame, pattern: str) -> DataFrame:
    """index, relative, mtime, length of what matches, from entries().

    A literal part behind a wildcard must be there in every directory that the wildcard matched, and two files must not
    have the same index: both are errors.
    """
    found = listed.withColumn("index", index_of(pattern, F.col("relative"))).filter("index is not null")
    parts = pattern.rstrip("/").split("/")
    first = next((i for i, p in enumerate(parts) if "*" in p), len(parts))
    for i in range(first + 1, len(parts)):
        if "*" not in parts[i]:
            above = "/".join(parts[:i]) + "/"
            here = "/".join(parts[: i + 1]) + ("/" if i < len(parts) - 1 or pattern.endswith("/") else "")
            indices = lambda p: listed.select(index_of(p, F.col("relative")).alias("above")).filter("above is not null").distinct()
            if (lost := indices(above).join(indices(here), "above", "left_anti").first()) is not None:
                raise FileNotFoundError(f"{parts[i]} of {pattern} is missing under {'/'.join(lost['above'])}")
    twice = found.groupBy("index").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"several files of {pattern} have the index {'/'.join(twice['index'])}")
    return found.select("index", "relative", "mtime", "length")


def deep_mtime(listed: DataFrame) -> DataFrame:
    """relative, mtime, n of every directory: the latest time of it and of all below it, at any depth, and the number of files
    there. Files are summed up for the directory that holds them, and directories go to their ancestors."""
    home = F.when(F.col("directory"), F.col("relative")).otherwise(F.regexp_extract("relative", "^(.*/)?[^/]*$", 1))
    homes = listed.groupBy(home.alias("home")).agg(F.max("mtime").alias("mtime"), F.sum((~F.col("directory")).cast("long")).alias("file"))
    parts = F.split(F.rtrim(F.col("home"), F.lit("/")), "/")
    own = F.when(F.col("home") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), own), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    spread = homes.select(F.explode(above).alias("folder"), "mtime", "file")
    return spread.groupBy(F.col("folder").alias("relative")).agg(F.max("mtime").alias("mtime"), F.sum("file").alias("n"))


def file_versions(root: str, wanted: DataFrame) -> DataFrame:
    """relative, version of files (relative) under a root, each read in a task as a stream: no other file is opened. One that went
    meanwhile has none."""
    from .roots import filesystem

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            versions = []
            for name in names:
                state = hashlib.sha512()
                try:
                    with system.open_input_stream(f"{base}/{name}") as source:
                        while chunk := source.read(CHUNK):
                            state.update(chunk)
                    versions.append(state.hexdigest().upper())
                except FileNotFoundError:
                    versions.append(None)
            yield pa.RecordBatch.from_pydict({"relative": names, "version": pa.array(versions, pa.string())})

    return dealt(wanted.select("relative"), "relative").mapInArrow(read, "relative string, version string")


def digests(spark: SparkSession, root: str, listed: DataFrame, cache: DataFrame, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(relative, version, recomputed of all files and directories listed by entries(); the new cache: relative, cached, cache_mtime).
    depth: parts of the paths of the directories at the top, if not the whole root was listed; the cache is of what is under them.

    A file's cached version counts if its time is strictly later than the file's; other files are read and hashed. A directory's
    counts if besides nothing below it was read again, or went, or came. What the cache holds of absent entries goes.
    """
    from ..functions.fingerprints import refreshed_tree
    from ..operators.staleness import fresh_hashes

    deep = deep_mtime(listed).select("relative", "mtime")
    times = listed.filter("not directory").select("relative", "mtime").union(deep)
    states = settle(fresh_hashes(times, cache, ["relative"]))
    is_dir = F.col("relative").endswith("/") | (F.col("relative") == "")
    hits, no = states.filter("state = 'hit'"), F.lit(None).cast("timestamp").alias("was")
    again = settle(file_versions(root, states.filter(~is_dir & F.col("state").isin("miss", "stale"))))
    files = hits.filter(~is_dir).select("relative", F.col("cached").alias("version"), F.lit(False).alias("recomputed"), F.col("cache_mtime").alias("was")).union(again.select("relative", "version", F.lit(True), no))
    # the root is a directory over all others; a top's path becomes one part, which has none above
    parts = F.split("relative", "/")
    inside = (F.concat(F.lit("./"), "relative") if depth == 0 else F.concat(F.array_join(F.slice(parts, 1, depth), "\0"), F.lit("/"), F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), "/"))).alias("path")
    outside = F.substr("path", F.lit(3)) if depth == 0 else F.replace("path", F.lit("\0"), F.lit("/"))
    stored = hits.filter(is_dir).select(inside, F.col("cached").alias("version"))
    gone = states.filter("state = 'orphan'").select(inside)
    folders = listed.filter("directory").select(inside)
    tree = refreshed_tree(files.select(inside, "version", F.col("recomputed").alias("changed")), gone, stored, folders)
    kept = hits.filter(is_dir).select("relative", F.col("cache_mtime").alias("was"))
    everything = settle(files.union(tree.select(outside.alias("relative"), "version", "recomputed").join(kept, "relative", "left").select("relative", "version", "recomputed", "was")))
    new = everything.filter("version is not null")
    return everything.drop("was"), new.select("relative", F.col("version").alias("cached"), F.when(F.col("recomputed") | F.col("was").isNull(), F.current_timestamp()).otherwise(F.col("was")).alias("cache_mtime"))


def hashed(spark: SparkSession, root: str, items: DataFrame, cache: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relative, version of the items; the new cache: relative, cached, cache_mtime).

    A cached version counts if its time is strictly later than the file's; other files are read and hashed, and what the cache holds
    of absent files goes. If there are directories among the items, listed (from entries(); listed here if it isn't given) and the cache are
    of the whole root, and so is the new cache.
    """
    from ..operators.staleness import fresh_hashes

    if not items.filter(F.col("relative").endswith("/") | (F.col("relative") == "")).isEmpty():
        everything, new = digests(spark, root, entries(spark, root) if listed is None else listed, cache)
        return everything.join(items.select("relative"), "relative", "left_semi").select("relative", "version"), new
    states = settle(fresh_hashes(items.select("relative", "mtime", "length"), cache, ["relative"]))
    computed = settle(file_versions(root, states.filter("state in ('miss', 'stale')")).withColumnRenamed("version", "computed"))
    versions = states.filter("state <> 'orphan'").join(computed, "relative", "left")
    versions = settle(versions.select("relative", F.when(F.col("state") == "hit", F.col("cached")).otherwise(F.col("computed")).alias("version"), F.when(F.col("state") == "hit", F.col("cache_mtime")).otherwise(F.current_timestamp()).alias("cache_mtime")))
    return versions.select("relative", "version"), versions.filter("version is not null").select("relative", F.col("version").alias("cached"), "cache_mtime")


#: the cache's folder under a root
CACHE = f"{FOLDER}/hashes"


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """relative, cached, cache_mtime: what was written last; nothing before."""
    from .roots import _exists, filesystem

    none = spark.createDataFrame([], "relative string, cached string, cache_mtime timestamp")
    if not _exists(f"{root.rstrip('/')}/{CACHE}/last"):
        return none
    system, base = filesystem(f"{root.rstrip('/')}/{CACHE}")
    with system.open_input_stream(f"{base}/last") as source:
        return spark.read.schema(none.schema).parquet(f"{root.rstrip('/')}/{CACHE}/{source.read().decode()}")


def write_cache(cache: DataFrame, root: str) -> None:
    """Puts a cache in the place of the last one, which goes once the new one is named."""
    from pyarrow.fs import FileSelector

    from .roots import filesystem

    name = f"cache-{uuid.uuid4().hex}"
    cache.write.parquet(f"{root.rstrip('/')}/{CACHE}/{name}")
    system, base = filesystem(f"{root.rstrip('/')}/{CACHE}")
    with system.open_output_stream(f"{base}/{name}.last") as out:
        out.write(name.encode())
    system.move(f"{base}/{name}.last", f"{base}/last")
    for x in system.get_file_info(FileSelector(base)):
        if x.base_name.startswith("cache-") and x.base_name != name:
            system.delete_dir(x.path)


def cached_versions(spark: SparkSession, root: str, listed: dict[str, DataFrame]) -> DataFrame:
    """relative, version of what was listed by pattern (relative, mtime, length), by the root's cache, which is brought up to date: what it
    held of absent elements of these patterns goes, what it holds of others stays."""
    cache = settle(read_cache(spark, root))
    found, held, scopes = [], [], []
    plain = [p for p in listed if not p.endswith("/")]
    if plain:
        items = functools.reduce(DataFrame.union, [listed[p].select("relative", "mtime", "length") for p in plain]).distinct()
        scopes.append(functools.reduce(lambda a, b: a | b, [index_of(p, F.col("relative")).isNotNull() for p in plain]))
        some, new = hashed(spark, root, items, cache.filter(scopes[-1]))
        found.append(some)
        held.append(new)
    for p in listed:
        if p.endswith("/"):  # all that is below them, and nothing else, is looked at
            tops = listed[p].select("relative")
            scopes.append(F.regexp_like("relative", F.lit(compiled(p)[0].removesuffix("$"))))
            some, new = digests(spark, root, entries(spark, root, tops), cache.filter(scopes[-1]), p.count("/"))
            found.append(some.join(tops, "relative", "left_semi").select("relative", "version"))
            held.append(new)
    versions = settle(functools.reduce(DataFrame.union, found).dropDuplicates(["relative"]))
    rest = cache.filter(~functools.reduce(lambda a, b: a | b, scopes))
    new = functools.reduce(DataFrame.union, [h.select("relative", "cached", "cache_mtime") for h in held]).dropDuplicates(["relative"]).union(rest)
    new, columns = settle(new), ["relative", "cached", "cache_mtime"]
    if not (new.join(cache, columns, "left_anti").isEmpty() and cache.join(new, columns, "left_anti").isEmpty()):
        write_cache(new, root)
    return versions


def cached_digests(spark: SparkSession, root: str) -> DataFrame:
    """relative, version, recomputed of all files and directories under a root, by its cache, which is brought up to date."""
    everything, new = digests(spark, root, entries(spark, root), read_cache(spark, root))
    write_cache(new, root)
    return everything
