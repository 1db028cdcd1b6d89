"""Content and structure fingerprints: upper-case hex digests."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle

if TYPE_CHECKING:
    import pyarrow as pa

#: digest length in bits; 512 for versions on disk, 256 where another engine is to agree
VERSION_BITS = 512
#: bytes of names and digests of a parent's children that are put together in memory at most
SMALL_PARENT = 8 << 20


def version(content: Column, bits: int = VERSION_BITS) -> Column:
    """Version of a content (binary, or text as UTF-8): name and attributes play no part."""
    return F.upper(F.sha2(content, bits))


def short_version(v: Column) -> Column:
    return F.lower(F.left(v, F.lit(8)))


def merkle(children: DataFrame, by: list[str], name: str, child_version: str, bits: int = VERSION_BITS, order: list[str] | None = None) -> DataFrame:
    """One level of a Merkle tree: by, n, version: for each parent the digest of its children's names and then their raw digests,
    both in an order (by default that of names). Null names and digests add nothing.

    A digest is sequential, so one task reads a parent's children. Parents of up to ``SMALL_PARENT`` bytes of names and digests are put
    together and hashed by built-in functions. Of larger ones a task reads the children as a sorted stream and holds a batch and
    a state of the hash, however many there are; Spark sorts on disk what memory can't hold. The children are written before.
    """
    order = order or [name]
    used = settle(children.select(*dict.fromkeys([*by, *order, name, child_version])))
    sizes = used.groupBy(*by).agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + F.coalesce(F.octet_length(child_version), F.lit(0)) + 64).alias("bytes"))
    large = settle(sizes.filter(F.col("bytes") > SMALL_PARENT).drop("bytes"))
    if large.isEmpty():
        return _merkle_small(used, by, name, child_version, bits, order)
    same = lambda a, b: F.lit(True) if not by else functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])
    small = used.join(large, same(used, large), "left_anti")
    return _merkle_small(small, by, name, child_version, bits, order).union(_merkle_stream(used.join(large, same(used, large), "left_semi"), by, name, child_version, bits, order))


def _merkle_small(children: DataFrame, by: list[str], name: str, child_version: str, bits: int, order: list[str]) -> DataFrame:
    fields = [F.col(c).alias(f"order_{i}") for i, c in enumerate(order)]
    parts = F.array_sort(F.collect_list(F.struct(*fields, F.coalesce(F.col(name), F.lit("")).alias("name"), F.coalesce(F.col(child_version), F.lit("")).alias("digest"))))
    grouped = children.groupBy(*by).agg(F.count("*").alias("n"), parts.alias("parts"))
    joined = lambda field: F.array_join(F.transform("parts", lambda x: x[field]), "")
    return grouped.select(*by, "n", F.upper(F.sha2(F.concat(F.encode(joined("name"), "UTF-8"), F.unhex(joined("digest"))), bits)).alias("version"))


def _merkle_stream(children: DataFrame, by: list[str], name: str, child_version: str, bits: int, order: list[str]) -> DataFrame:
    keys, kinds = [F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], [children.schema[c].dataType.simpleString() for c in by]
    pieces = F.array(*[F.struct(F.lit(part).alias("part"), piece.alias("piece")) for part, piece in enumerate((F.encode(name, "UTF-8"), F.unhex(child_version)))])
    rows = children.select(*keys, *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], F.inline(pieces))
    by_keys = [f"by_{i}" for i in range(len(by))]
    ordered = rows.repartition(*by_keys).sortWithinPartitions(*by_keys, "part", *[f"order_{i}" for i in range(len(order))])
    schema = ", ".join([*[f"{k} {kind}" for k, kind in zip(by_keys, kinds, strict=True)], "n long", "version string"])
    digests = ordered.select(*by_keys, "part", "piece").mapInArrow(_digests(len(by), bits), schema)
    return digests.select(*[F.col(k).alias(c) for k, c in zip(by_keys, by, strict=True)], "n", "version")


def _digests(n_keys: int, bits: int):
    """Batches of sorted (keys, part, piece) to keys, n (pieces of part 0), version, one row for each run of equal keys."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group, n, state = None, 0, None
        types = []

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            names = [*[f"by_{i}" for i in range(n_keys)], "n", "version"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64(), pa.string()], strict=True)], names)

        for batch in batches:
            types = [c.type for c in batch.columns[:n_keys]]
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[: n_keys + 1]]
            changes = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
            bounds = np.concatenate(([0], np.flatnonzero(changes) + 1, [batch.num_rows])).astype(np.int32) if batch.num_rows else np.zeros(1, np.int32)
            pieces = pc.fill_null(batch.column(n_keys + 1), b"")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pieces), b"")
            done = []
            for start, end, piece in zip(bounds[:-1].tolist(), bounds[1:].tolist(), joined, strict=True):
                key = tuple(c[start].as_py() for c in batch.columns[:n_keys])
                if state is None or key != group:
                    if state is not None:
                        done.append((*group, n, state.hexdigest().upper()))
                    group, n, state = key, 0, hashlib.new(f"sha{bits}")
                state.update(piece.as_buffer())
                if batch.column(n_keys)[start].as_py() == 0:
                    n += end - start
            if done:
                yield out(done)
        if state is not None:
            yield out([(*group, n, state.hexdigest().upper())])

    return stream


def merkle_tree(files: DataFrame, bits: int = VERSION_BITS) -> DataFrame:
    """path, version of every directory above the files (path, version): one grouping a level, from the deepest up.

    Files come before directories in a directory's digest, each sorted by name; hidden files and side files are left out.
    """
    from .paths import HASH_SUFFIX, META_SUFFIX

    parent = lambda p: F.regexp_extract(p, "^(.*/)[^/]+/?$", 1)
    name = lambda p: F.regexp_extract(p, "([^/]+)/?$", 1)
    ours = ~(name(F.col("path")).startswith(".") | F.lower("path").endswith(HASH_SUFFIX) | F.lower("path").endswith(META_SUFFIX))
    nodes = files.filter(ours).select(parent(F.col("path")).alias("dir"), F.lit(0).alias("kind"), name(F.col("path")).alias("name"), "version")
    depth = F.size(F.split("dir", "/"))
    deepest = nodes.agg(F.max(depth)).first()[0]
    found = None
    pending = nodes
    for level in range(deepest or 0, 1, -1):
        here = pending.filter(depth == level)
        done = merkle(here, ["dir"], "name", "version", bits, ["kind", "name"])
        up = done.select(parent(F.col("dir")).alias("dir"), F.lit(1).alias("kind"), name(F.col("dir")).alias("name"), "version").filter("dir <> ''")
        pending = pending.filter(depth < level).union(up)
        rows = done.select(F.col("dir").alias("path"), "version")
        found = rows if found is None else found.union(rows)
    return found if found is not None else files.select("path", "version").limit(0)


def refreshed_tree(files: DataFrame, gone: DataFrame, stored: DataFrame, folders: DataFrame | None = None, bits: int = VERSION_BITS) -> DataFrame:
    """path, version, recomputed of every directory, from its digest in store where nothing below it changed.

    files: path, version, changed (or new) of all that is there; gone: path of files and directories (with a final ``/``) that no longer are;
    stored: path, version of the directories then; folders: path of those that are there without files, if they count. What changed
    marks its ancestors, and so does a directory of which nothing is stored: only these are made anew, from the deepest up, each from its
    children's digests, made anew or stored. Their number grows with the changes times the depth, not with the tree.
    """
    from .paths import HASH_SUFFIX, META_SUFFIX

    name = lambda p: F.regexp_extract(p, "([^/]+)/?$", 1)
    parent = lambda p: F.regexp_extract(p, "^(.*/)[^/]+/?$", 1)
    seen = lambda c: ~(name(F.col(c)).startswith(".") | F.lower(c).endswith(HASH_SUFFIX) | F.lower(c).endswith(META_SUFFIX))
    steps = F.split("path", "/")

    def above(paths: DataFrame) -> DataFrame:
        """All directories over some paths."""
        bare = F.split(F.rtrim(F.col("path"), F.lit("/")), "/")
        ks = F.when(F.size(bare) > 1, F.sequence(F.lit(1), F.size(bare) - 1))
        return paths.select(F.explode(F.transform(ks, lambda k: F.concat(F.array_join(F.slice(bare, 1, k), "/"), F.lit("/")))).alias("path")).distinct()

    files = files.filter(seen("path")).select("path", "version", "changed")
    # files count once for the directory that holds them, not for each above it
    homes = settle(files.groupBy(parent(F.col("path")).alias("path")).agg(F.bool_or("changed").alias("changed")).filter("path <> ''"))
    there = homes.select("path").union(above(homes))
    if folders is not None:
        there = there.union(folders.select("path")).union(above(folders))
    there = settle(there.distinct())
    new = there.join(stored.select("path"), "path", "left_anti")
    changed = homes.filter("changed").select("path")
    marks = changed.union(gone.filter(seen("path")).select("path")).union(new)
    dirty = settle(above(marks).union(changed).union(new).distinct().join(there, "path", "left_semi").withColumn("depth", F.size(F.split("path", "/"))))
    clean = settle(there.join(dirty, "path", "left_anti").join(stored.select("path", "version"), "path"))
    # children of dirty directories: files and clean directories at once, dirty ones level by level
    child = lambda rows, kind: rows.select(parent(F.col("path")).alias("dir"), F.lit(kind).alias("kind"), name(F.col("path")).alias("name"), "version")
    known = child(files, 0).union(child(clean, 1))
    if not clean.isEmpty():
        known = known.join(dirty.select(F.col("path").alias("dir")), "dir", "left_semi")
    known, ups = known.withColumn("depth", F.size(F.split("dir", "/"))), None
    out = clean.select("path", "version", F.lit(False).alias("recomputed"))
    levels = [r[0] for r in dirty.select("depth").distinct().orderBy(F.col("depth").desc()).collect()]  # one entry a level
    for level in levels:
        here = known if ups is None else known.union(ups)
        here = here.filter(F.col("depth") == level)
        done = settle(merkle(here, ["dir"], "name", "version", bits, ["kind", "name"]).select(F.col("dir").alias("path"), "version"))
        none = F.upper(F.sha2(F.lit(b""), bits))
        bare = dirty.filter(F.col("depth") == level).select("path").join(done.select("path"), "path", "left_anti").select("path", none.alias("version"))
        done = done.union(bare)
        out = out.union(done.select("path", "version", F.lit(True)))
        up = child(done, 1).filter("dir <> ''").withColumn("depth", F.size(F.split("dir", "/")))
        ups = settle(up if ups is None else up.union(ups.filter(F.col("depth") < level)))
    return out


def directory_versions(inside: DataFrame, bits: int = VERSION_BITS) -> DataFrame:
    """index, version of directories from what is inside them: index, path, version of files (inner directories end with ``/``, the directory
    itself has an empty path). Nothing above the directories is looked at."""
    top = F.concat(F.md5(F.to_json("index")), F.lit("/"))
    rows = settle(inside.select("index", top.alias("top"), F.concat(top, "path").alias("path"), "version"))
    is_file = ~F.col("path").endswith("/")
    none = rows.select("path").limit(0)
    tree = refreshed_tree(rows.filter(is_file).select("path", "version", F.lit(True).alias("changed")), none, none.select("path", F.lit("").alias("version")), rows.filter(~is_file).select("path"), bits)
    return rows.select("index", F.col("top").alias("path")).distinct().join(tree, "path").select("index", "version")


def signature(command: Column, working_dir: Column, inputs: Column, outputs: Column) -> Column:
    """Signature of a method: its command, working directory, input and output paths in order, without separators."""
    return F.upper(F.sha1(F.encode(F.concat(command, working_dir, F.array_join(inputs, ""), F.array_join(outputs, "")), "UTF-8")))
