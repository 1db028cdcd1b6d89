"""N-gram Jaccard self-join by chosen paths: all pairs of texts whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more.

Texts with the same words in the same order are one node. In each of several runs a set follows a path: at
each step it picks the shingle with the smallest hash under the path so far, so that two sets pick the same
one with the probability of their similarity. Sets that share a path are a bucket. A bucket of at most
``LEAF`` sets is compared by brute force; a larger one is split by the next step of the path, unless
its largest part keeps half of it (then its sets are alike, and splitting would only lose pairs) or
the path ends: it is then compared in blocks.

At the threshold two sets stay together through k steps of a run with probability 0.8 ** k. The target recall
is a parameter. All sets make the runs that reach it with two steps each; sets of which any path was split
make further runs among themselves, up to those that reach it when all runs take ``DEPTH`` steps (for 0.999:
8 runs, then 7). Sets whose paths were never split miss a partner with a probability of 0.2 ** 8 only.

Pairs are first judged on 64 one-byte minhashes (a pair at the threshold fails with a probability under
1e-6), then exactly on the whole sets, which only texts with a promising partner contribute. A pair is
judged in the first run in which it meets, so links are counted once.

Defined cases: words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged; a text of fewer
than five words has all of them as its one shingle; texts without words (null too) are equal to one
another and to nothing else; n_links counts other rows, copies included; a class is what links connect and
its id is the smallest doc_id in it (null if all are null); rows that repeat a doc_id count as rows;
an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, numbered, row_column, run_hashes, runs_of, settle, slices, without_ids
from .links import WIDE, components, linked, matrix, promising, with_sizes

WORDS, THRESHOLD = 5, 0.8
#: probability at least of finding a pair at the threshold
RECALL = 0.999
DEPTH, LEAF = 4, 64
SKETCH, SKETCH_LEAST = 64, 35
#: nodes whose sets are fetched by broadcast at most, 8 bytes each; more are joined by shuffle
BROADCAST_NODES = 1 << 20

_SALTS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64)


def runs_for(steps: int, recall: float = RECALL) -> int:
    """Runs of so many steps each that a partner at the threshold stays away from with probability (1 - recall) / 2 at most."""
    return math.ceil(math.log((1 - recall) / 2) / math.log(1 - THRESHOLD**steps))


def node_numbers(words: Words) -> np.ndarray:
    """A number for each text's sequence of words."""
    h = run_hashes(words.hashes, words.word_at[:-1], words.word_at[1:]) if len(words.hashes) else np.zeros(len(words.word_at) - 1, np.uint64)
    return (h >> np.uint64(1)).astype(np.int64)


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles one text after the other, repeats included, and the texts' offsets among them."""
    counts = words.counts()
    short = (counts < WORDS) & (counts > 0)
    at = np.concatenate([[0], np.cumsum(np.maximum(counts - WORDS + 1, short))])
    out, whole = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool)
    whole[at[:-1][short]] = True
    out[~whole] = runs_of(words, WORDS)[0]
    if short.any():
        out[whole] = run_hashes(words.hashes, words.word_at[:-1][short], words.word_at[1:][short])
    return out, at


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted hashes of each text's shingles."""
    flat, at = shingles_of(words)
    return [np.unique(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Minima:
    """Least hashes of each text's shingles, for the texts that have any, all texts of a slice at once."""

    def __init__(self, words: Words):
        self.flat, at = shingles_of(words)
        self.sizes = np.diff(at)
        self.some = self.sizes > 0
        self.heads = at[:-1][self.some]

    def least(self, factor: np.ndarray | np.uint64) -> np.ndarray:
        """Shingles are hashes already: a random odd factor orders them anew."""
        return np.minimum.reduceat(self.flat * factor, self.heads) if len(self.heads) else np.zeros(0, np.uint64)

    def paths(self, runs: range) -> np.ndarray:
        """Hashes of the paths after each step, run by run, in a row for each text with shingles."""
        out = np.zeros((len(self.heads), len(runs) * DEPTH), np.int64)
        for i, run in enumerate(runs):
            path = np.full(len(self.heads), _SALTS[run])
            for step in range(DEPTH):
                factor = np.repeat(path | np.uint64(1), self.sizes[self.some])
                path = mix64(mix64(self.least(factor)) + path)
                out[:, i * DEPTH + step] = (path >> np.uint64(1)).astype(np.int64) | 1
        return out

    def sketches(self) -> np.ndarray:
        """A byte of each of ``SKETCH`` minhashes, in a row for each text with shingles; memory is one array of the slice's shingles."""
        out = np.zeros((len(self.heads), SKETCH), np.uint8)
        for k in range(SKETCH):
            out[:, k] = (mix64(self.least(_SALTS[k + 128] | np.uint64(1))) >> np.uint64(20)).astype(np.uint8)
        return out

    def listed(self, rows: np.ndarray) -> pa.Array:
        """The rows of numbers as lists, null for texts without shingles."""
        width = rows.shape[1] if rows.size else 0
        offsets = np.concatenate([[0], np.cumsum(self.some)]).astype(np.int32) * width
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
        return pc.if_else(pa.array(self.some), lists, pa.scalar(None, lists.type))


def paths_of(words: Words, runs: range) -> pa.Array:
    made = Minima(words)
    return made.listed(made.paths(runs))


def described(docs: DataFrame, runs: range, number: str | None = None) -> DataFrame:
    """doc_id, node, paths (null: no words), sketch of each row. number: the column of the rows' numbers, which are returned too (row_)."""
    row = ["row_"] if number else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"))
                made = Minima(words)
                sketches = iter(made.sketches())
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(batch.column, row),
                        batch.column("doc_id"),
                        pa.array(node_numbers(words)),
                        made.listed(made.paths(runs)),
                        pa.array([next(sketches).tobytes() if s else None for s in made.some], pa.binary()),
                    ],
                    [*row, "doc_id", "node", "paths", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*row_column(number), "doc_id", "text").mapInArrow(run, ("row_ long, " if row else "") + f"doc_id {kind}, node long, paths array<long>, sketch binary")


def leaves_of(nodes: DataFrame, runs: range) -> tuple[DataFrame, list[DataFrame]]:
    """The buckets of at least two nodes in which the paths of each node end (node, run, leaf, n), and the
    nodes of each split."""
    active = nodes.select("node", F.explode(F.sequence(F.lit(runs.start), F.lit(runs.stop - 1))).alias("run"), "paths")
    active = active.select("node", "run", F.slice("paths", (F.col("run") - runs.start) * DEPTH + 1, F.lit(DEPTH)).alias("path"))
    active = active.withColumn("leaf", F.col("path")[0])
    sizes = active.groupBy("run", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    active = settle(active.join(sizes, ["run", "leaf"]), "paths")
    done, splits = [active.filter(F.col("n") <= LEAF).select("node", "run", "leaf", "n")], []
    active = active.filter(F.col("n") > LEAF)
    for depth in range(1, DEPTH):
        if not active.limit(1).count():
            break
        steps = active.withColumn("next", F.col("path")[depth])
        sizes = steps.groupBy("run", "leaf", "next").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        sizes = settle(sizes, "sizes")
        largest = sizes.groupBy("run", "leaf").agg(F.max("m").alias("largest"), F.first("n").alias("n_"))
        alike = largest.filter("2 * largest >= n_").select("run", "leaf")
        done.append(steps.join(alike, ["run", "leaf"], "left_semi").select("node", "run", "leaf", "n"))
        splits.append(steps.join(alike, ["run", "leaf"], "left_anti").select("node"))
        split = sizes.join(alike, ["run", "leaf"], "left_anti").filter("m > 1").drop("n")
        below = steps.join(split, ["run", "leaf", "next"]).select("node", "run", "path", F.col("next").alias("leaf"), F.col("m").alias("n"))
        below = settle(below, "paths")
        last = depth == DEPTH - 1
        done.append((below if last else below.filter(F.col("n") <= LEAF)).select("node", "run", "leaf", "n"))
        active = below.filter(F.col("n") > LEAF)
    return _union(done), splits


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def alike_sketches(a: pa.Table, b: pa.Table, mask: np.ndarray) -> np.ndarray:
    x, y = matrix(a, "sketch", "u1"), matrix(b, "sketch", "u1")
    i, j = np.nonzero(mask)
    out = np.zeros_like(mask)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[p, q] = (x[p] == y[q]).sum(axis=1) >= SKETCH_LEAST
    return out


def alike_sets(a: pa.Table, b: pa.Table, mask: np.ndarray) -> np.ndarray:
    """Exact: intersections of whole sets, as products of rows over the shingles that several sets have."""
    mask = alike_sketches(a, b, mask)
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return mask
    x = [np.frombuffer(v, "<u8") for v in a.column("shingles").take(pa.array(rows)).to_pylist()]
    y = [np.frombuffer(v, "<u8") for v in b.column("shingles").take(pa.array(columns)).to_pylist()]
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    i, j = np.nonzero(mask[np.ix_(rows, columns)])
    if len(i) <= 2 * (len(x) + len(y)):
        common = np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(i, j, strict=True)])
    else:
        shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
        common = np.zeros(len(i), np.int64)
        at = lambda sets, part: [np.searchsorted(part, s[np.isin(s, part, assume_unique=True)]) for s in sets]
        for k in range(0, len(shared), 1 << 13):  # bounded memory, whatever the sets
            part = shared[k : k + (1 << 13)]
            left, right = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
            for m, places in ((left, at(x, part)), (right, at(y, part))):
                for r, place in enumerate(places):
                    m[r, place] = 1
            common += (left @ right.T)[i, j].astype(np.int64)
    out = np.zeros_like(mask)
    good = 5 * common >= 4 * (nx[i] + ny[j] - common)  # common / union >= 0.8 in whole numbers
    out[rows[i[good]], columns[j[good]]] = True
    return out


def from_sets(docs: DataFrame, nodes: DataFrame, make: Callable[[Words], pa.Array], column: str, kind: str) -> DataFrame:
    """node and a column made from its shingles, once for each of the nodes (node, rep). Rows are looked for by
    the smallest doc_id of their node, or among all those without one, and known by the node's number."""
    few = nodes.count() <= BROADCAST_NODES
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(nodes.select("node").toArrow().column("node").to_numpy())) if few else None

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"))
                numbers = node_numbers(words)
                those = np.isin(numbers, wanted.value) if wanted is not None else np.ones(len(numbers), bool)
                if not those.any():
                    continue
                if not those.all():
                    words, numbers = Words(batch.column("text").filter(pa.array(those))), numbers[those]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), make(words)], ["node", column])

    reps = nodes.select(F.col("rep").alias("rep_"))
    rows = docs.select("doc_id", "text").join(F.broadcast(reps) if few else reps, F.col("doc_id") == F.col("rep_"), "left_semi").select("text")
    if nodes.filter("rep is null").limit(1).count():
        rows = rows.union(docs.filter("doc_id is null").select("text"))
    made = rows.mapInArrow(number, f"node long, {column} {kind}")
    if not few:
        made = made.join(nodes.select("node"), "node", "left_semi")
    return made.dropDuplicates(["node"])


def sets_of(words: Words) -> pa.Array:
    return pa.array([s.astype("<u8").tobytes() for s in shingle_sets(words)], pa.binary())


def near_classes(docs: DataFrame, recall: float = RECALL, number: str | None = None) -> DataFrame:
    """doc_id, class_id, n_links, kept of every row; kept: the rows with the class's id. number: the column of the rows' numbers;
    then they are returned too (row_), and one row of each class is kept."""
    row = ["row_"] if number else []
    runs, most = runs_for(2, recall), runs_for(DEPTH, recall)
    rows = settle(described(docs, range(runs), number), "rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    nodes = settle(nodes, "nodes")
    ends, splits = leaves_of(nodes.filter("paths is not null"), range(runs))
    ends = settle(ends, "ends")
    short = settle(_union(splits).select("node").distinct(), "short") if splits else None
    if short is not None and short.limit(1).count():
        further = range(runs, most)
        again = settle(nodes.join(short, "node", "left_semi").select("node", "rep"), "again")
        paths = from_sets(docs, again, lambda words: paths_of(words, further), "paths", "array<long>")
        ends = ends.union(settle(leaves_of(settle(paths, "further"), further)[0], "ends"))
    leaves = ends.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("by_run"))
    packed = F.unhex(F.concat_ws("", *[_little_endian(F.coalesce(F.try_element_at("by_run", F.lit(r)), F.lit(0))) for r in range(most)]))
    known = settle(leaves.select("node", packed.alias("leaves")).join(nodes.select("node", "copies", "sketch", "rep"), "node"), "known")
    members = ends.join(known.drop("rep"), "node")
    # whole sets go to the buckets only in which a node has such a pair for the first time
    hopeful = settle(promising(members, alike_sketches, WIDE), "hopeful")
    fetched = settle(known.join(hopeful.select("node").distinct(), "node", "left_semi").select("node", "rep"), "fetched")
    sets = from_sets(docs, fetched, sets_of, "shingles", "binary")
    full = settle(known.drop("rep").join(sets, "node"), "sets")
    members = with_sizes(hopeful).join(full, "node")
    found = settle(linked(members, alike_sets), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.select("node", "rep", "copies").join(stars, "node", "left").join(counts, "node", "left")
    placed = settle(placed.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "placed")
    names = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    verdicts = placed.join(names, "root").select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select(*row, "doc_id", "node").join(verdicts, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    if row:
        firsts = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_")).alias("first"))
        firsts = firsts.join(placed.select("node", "root"), "node").groupBy("root").agg(F.min("first")["row_"].alias("first_"))
        out = out.join(settle(firsts.select("first_"), "firsts"), F.col("row_") == F.col("first_"), "left")
        kept = F.col("first_").isNotNull()
    return out.select(*row, "doc_id", "class_id", "n_links", kept.alias("kept"))


def _little_endian(value):
    """Hex of a 64-bit number, lowest byte first."""
    h = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each class, with all their columns."""
    rows, row = numbered(docs)
    dropped = near_classes(rows, number=row).filter("not kept").select("row_")
    return without_ids(rows, row, settle(dropped, "dropped")).drop(row)
