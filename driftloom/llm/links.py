"""Links between rows that share buckets: blocks of pairs, each pair judged once, and connected components.

A row has a bucket key (or none) in each of several runs. Two rows are compared in the first run in which
they share a bucket. Buckets of any size are split into blocks of about so many rows, and every pair of
blocks is a unit of work of its own, so that no task gets a whole large bucket. Pairs stay inside the
unit; what leaves it is linear in its rows: counts of links and a spanning forest. A bucket of n rows is dealt
n / block times: blocks of small rows (sketches) are ``WIDE``, those of whole sets and vectors ``BLOCK`` rows long.

Defined cases: no members, or members alone in their buckets, give no rows; a bucket number of 0 means no bucket;
a node that several units link is in several rows, which callers add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BLOCK, WIDE = 192, 1024

#: gets two lists of rows (Arrow tables: node, copies, leaves and what else was asked for) and a mask of pairs
#: to compare; returns the mask of pairs that link
Judge = Callable[[pa.Table, pa.Table, np.ndarray], np.ndarray]


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """members: run, leaf, n (rows of the bucket), node. Adds left, right (the blocks of a unit) and side (the row's own block)."""
    blocks: Column = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(*members.columns, "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (run, leaf, left, right), cut where the unit changes, whatever the batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("run", "leaf", "left", "right")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if rest:
            last = tuple(rest[-1].column(c)[-1].as_py() for c in ("run", "leaf", "left", "right"))
            if last != tuple(key[:, 0].tolist()):
                yield pa.Table.from_batches(rest)
                rest = []
        start = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*rest, batch.slice(start, cut - start)])
            rest, start = [], cut
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def matrix(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    """A column of binaries of equal length, as rows of numbers."""
    values = table.column(column).to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def pairs_in(unit: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Both sides of a unit, and the pairs whose first shared bucket this is."""
    side, left, right = unit.column("side").to_numpy(), unit.column("left")[0].as_py(), unit.column("right")[0].as_py()
    a = unit.filter(pa.array(side == left)) if left != right else unit
    b = unit.filter(pa.array(side == right)) if left != right else unit
    x, y, run = matrix(a, "leaves", "<i8"), matrix(b, "leaves", "<i8"), unit.column("run")[0].as_py()
    mask = np.ones((len(x), len(y)), bool) if left != right else np.triu(np.ones((len(x), len(y)), bool), 1)
    for r in range(run):
        mask &= (x[:, r, None] != y[None, :, r]) | (x[:, r, None] == 0)
    return a, b, mask


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a[i] - b[i], and the smallest node that it reaches by them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def worked(members: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, block: int) -> DataFrame:
    """Applies work to every unit of the members (run, leaf, n, node, leaves, ...)."""
    spread = in_blocks(members, block).repartition("run", "leaf", "left", "right").sortWithinPartitions("run", "leaf", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for unit in units(batches):
            if unit.num_rows > 1 and (got := work(unit)) is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows
                if rows > 50_000:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                    out, rows = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return spread.mapInArrow(run, schema)


def promising(members: DataFrame, judge: Judge, block: int) -> DataFrame:
    """run, leaf, node of the members (distinct) that in this bucket have a pair which the judge lets pass."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        a, b, mask = pairs_in(unit)
        if not mask.any():
            return None
        mask = judge(a, b, mask)
        found = np.unique(np.concatenate([a.column("node").to_numpy()[mask.any(axis=1)], b.column("node").to_numpy()[mask.any(axis=0)]]))
        bucket = [pa.array([unit.column(c)[0].as_py()] * len(found), pa.int64()) for c in ("run", "leaf")]
        return pa.RecordBatch.from_arrays([*bucket, pa.array(found, pa.int64())], ["run", "leaf", "node"])

    return worked(members, work, "run long, leaf long, node long", block).distinct()


def with_sizes(members: DataFrame) -> DataFrame:
    """The members (run, leaf, node) of buckets that have at least two, with the number of members (n)."""
    sizes = members.groupBy("run", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(sizes, ["run", "leaf"])


def linked(members: DataFrame, judge: Judge) -> DataFrame:
    """node, links (copies of the nodes that it links with, from this unit), root (smallest node that it reaches there)."""

    def work(unit: pa.Table) -> pa.RecordBatch | None:
        a, b, mask = pairs_in(unit)
        if not mask.any():
            return None
        i, j = np.nonzero(judge(a, b, mask))
        if not len(i):
            return None
        x, y = a.column("node").to_numpy()[i], b.column("node").to_numpy()[j]
        nodes, roots = forest(x, y)
        links = np.bincount(np.searchsorted(nodes, x), weights=b.column("copies").to_numpy()[j], minlength=len(nodes))
        links += np.bincount(np.searchsorted(nodes, y), weights=a.column("copies").to_numpy()[i], minlength=len(nodes))
        return pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "links": pa.array(links.astype(np.int64)), "root": pa.array(roots, pa.int64())})

    return worked(members, work, "node long, links long, root long", BLOCK)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of the component) of every node that an edge (u, v) links to a smaller one.

    Alternates large-star and small-star steps, each a join and an aggregation, until all edges are stars.
    """
    tidy = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(tidy(edges), "edges")
    while True:
        centres = now.select(F.col("v").alias("u")).distinct()
        # a star: no centre hangs on another node, and each node on one centre
        several = now.groupBy("u").agg(F.count("*").alias("k")).filter("k > 1").select("u")
        if not now.join(centres, "u", "left_semi").select("u").limit(1).count() and not several.limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.filter("m < u").select("u", F.col("m").alias("v"))
        )
        large = settle(tidy(large), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = settle(tidy(small), "small")
