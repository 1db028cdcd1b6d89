"""Embedding near-dedup by collision-counting projections: all pairs of vectors with a cosine of 0.95 or more.

Vectors, scaled to length 1, are projected on random Gaussian lines; the difference of two vectors'
projections is then normal with their distance as deviation, whatever the data. Some lines, sorted and cut
into wide intervals at a random shift, form the cells in which pairs meet: ``TABLES`` times with lines of
their own, as many lines as bring a cell of evenly spread vectors to about ``CELL`` of them. Within a
cell, windows centred at one vector are laid over ``COUNTED`` other lines; a pair that collides in at
least ``LEAST`` of them is verified by its cosine in double precision.

Calibration at the threshold (distance 0.3162): a window of half-width ``WINDOW`` = 2 deviations catches a
pair with probability 0.9545 a line, so fewer than 25 of 32 collisions have a probability under 2e-4; the number of
tables is chosen so that a pair shares no cell with a probability under ``MISS``. Nearer pairs are found
more surely. Cells of any size are compared in blocks, each pair in the first table in which it meets. A first round
counts collisions only; whole vectors are then sent to the cells for those with a colliding partner.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
stay; equal vectors are one node and link with one another; vectors of different length never link; ties
go to the smallest vec_id; a null vec_id has itself as component unless it has links; rows that repeat a
vec_id count as rows; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .links import WIDE, components, linked, matrix, promising, with_sizes

THRESHOLD = 0.95
COUNTED, LEAST, DEVIATIONS = 32, 25, 2.0
CELL, MISS, WIDTH, MOST_LINES = 400, 5e-4, 2.0, 12


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Lines to a cell and tables for n vectors."""
    distance = math.sqrt(2 - 2 * threshold)

    def shares(deviation: float) -> float:
        """Probability that two projections so far apart fall into one interval of width WIDTH at a random shift."""
        t = np.linspace(-WIDTH, WIDTH, 4001)
        density = np.exp(-((t / deviation) ** 2) / 2) / (deviation * math.sqrt(2 * math.pi))
        return float(((1 - np.abs(t) / WIDTH) * density).sum() * (t[1] - t[0]))

    near, far = shares(distance), shares(math.sqrt(2))
    lines = min(MOST_LINES, max(1, math.ceil(math.log(max(n, 1) / CELL) / -math.log(far)))) if n > CELL else 1
    return lines, math.ceil(math.log(MISS) / math.log(1 - near**lines))


def lines_for(size: int, lines: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and shifts of the cells, and directions of the counted lines, for vectors of one size."""
    rng = np.random.Generator(np.random.PCG64(97 + size))
    return rng.standard_normal((size, tables * lines)), rng.random(tables * lines) * WIDTH, rng.standard_normal((size, COUNTED))


def described(vectors: DataFrame, lines: int, tables: int) -> DataFrame:
    """node (number of the vector's value), cells (one for each table), counted projections and the vector itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        mixer = np.random.Generator(np.random.PCG64(3)).integers(1, 2**62, lines * tables, dtype=np.int64) | 1
        for batch in batches:
            ids, values = batch.column("vec_id"), batch.column("embedding")
            at = values.offsets.to_numpy()
            flat = pc.fill_null(values.values, math.nan).to_numpy(zero_copy_only=False)
            sizes = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                x = flat[at[:-1][rows][:, None] + np.arange(size)]
                usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[usable], x[usable]
                if not len(rows):
                    continue
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                unit = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
                cell_lines, shifts, counted = lines_for(size, lines, tables)
                steps = np.floor((unit @ cell_lines + shifts) / WIDTH).astype(np.int64)
                cells = (steps * mixer).reshape(len(rows), tables, lines).sum(axis=2)
                cells = cells * 0x5DEECE66D + np.arange(1, tables + 1) * 7919 + size
                cells[cells == 0] = 1
                x = x + 0.0  # one zero only
                nodes = [int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array(nodes, pa.int64()),
                        pa.array([c.tobytes() for c in cells.astype("<i8")], pa.binary()),
                        pa.array(list(cells), pa.list_(pa.int64())),
                        pa.array([p.tobytes() for p in (unit @ counted).astype("<f4")], pa.binary()),
                        pa.array([u.tobytes() for u in x.astype("<f8")], pa.binary()),
                    ],
                    ["vec_id", "node", "leaves", "cells", "counted", "vector"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, f"vec_id {kind}, node long, leaves binary, cells array<long>, counted binary, vector binary"
    )


def colliding(threshold: float):
    window = np.float32(DEVIATIONS * math.sqrt(2 - 2 * threshold))

    def collide(a: pa.Table, b: pa.Table, mask: np.ndarray) -> np.ndarray:
        x, y = matrix(a, "counted", "<f4"), matrix(b, "counted", "<f4")
        count = np.zeros(mask.shape, np.int8)
        for k in range(COUNTED):
            count += np.abs(x[:, k, None] - y[None, :, k]) <= window
        return mask & (count >= LEAST)

    return collide


def judge(threshold: float):
    collide = colliding(threshold)

    def alike(a: pa.Table, b: pa.Table, mask: np.ndarray) -> np.ndarray:
        i, j = np.nonzero(collide(a, b, mask))
        out = np.zeros_like(mask)
        if not len(i):
            return out
        u, v = a.column("vector").to_pylist(), b.column("vector").to_pylist()
        sizes_u, sizes_v = np.array([len(z) for z in u]), np.array([len(z) for z in v])
        same = sizes_u[i] == sizes_v[j]
        i, j = i[same], j[same]
        for size in np.unique(sizes_u[i]):
            of = sizes_u[i] == size
            p, q = i[of], j[of]
            left = {r: np.frombuffer(u[r], "<f8") for r in np.unique(p)}
            right = {r: np.frombuffer(v[r], "<f8") for r in np.unique(q)}
            for k in range(0, len(p), 1 << 14):
                pa_, qa = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
                m, n = np.array([left[r] for r in pa_]), np.array([right[r] for r in qa])
                m, n = m / np.abs(m).max(axis=1, keepdims=True), n / np.abs(n).max(axis=1, keepdims=True)
                cosine = (m * n).sum(axis=1) / np.sqrt((m * m).sum(axis=1) * (n * n).sum(axis=1))
                out[pa_, qa] = cosine >= threshold
        return out

    return alike


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    lines, tables = plan(vectors.count(), threshold)
    rows = settle(described(vectors, lines, tables), "vectors")
    nodes = settle(
        rows.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("leaves", "cells", "counted", "vector")]), "nodes"
    )
    ends = nodes.select("node", F.posexplode("cells").alias("run", "leaf"))
    sizes = ends.groupBy("run", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    ends = settle(ends.join(sizes, ["run", "leaf"]), "ends")
    hopeful = settle(promising(ends.join(nodes.select("node", "leaves", "counted"), "node"), colliding(threshold), WIDE), "hopeful")
    chosen = nodes.join(hopeful.select("node").distinct(), "node", "left_semi").select("node", "copies", "leaves", "counted", "vector")
    found = settle(linked(with_sizes(hopeful).join(settle(chosen, "chosen"), "node"), judge(threshold)), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.select("node", "rep", "copies").join(stars, "node", "left").join(counts, "node", "left")
    placed = settle(placed.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "placed")
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    verdicts = placed.join(names, "root").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    usable = rows.select("vec_id", "node").join(verdicts, "node").select("vec_id", "n_links", "component_id")
    # vectors that can't be compared: the others by row, so that repeated ids stay rows
    e = F.col("embedding").cast("array<double>")
    bad = e.isNull() | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | F.forall(e, lambda x: x == 0)
    rest = vectors.filter(F.coalesce(bad, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = usable.union(rest)
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
