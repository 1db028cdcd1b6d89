"""Phrase collocation mining: merged count-min sketches pick the n-grams that are counted exactly.

Texts are cut into pieces at sentence marks and line ends, pieces into words. Tasks count hashed n-grams into the cells of
a sketch with two rows and send what they have counted, block by block, to the tasks that merge the blocks; a merged
sketch is reduced to one bit for each cell, whether it reached the least count. A count in a cell is never below that of an
n-gram in it, so an n-gram with an unset bit is rare. The first sketch has words and pairs; the second one has longer phrases
all of whose pairs may be frequent (every occurrence of a frequent phrase is counted: its pairs are frequent too). The last scan
counts exactly, by their words, only n-grams whose bits are set, so that nothing frequent is lost.

A sketch has a cell for every ``CELL_BYTES`` bytes of text in each row. Its bits are what all tasks get: beyond ``MOST_BITS`` cells in
a row they are folded, which lets more rare n-grams through to the exact count but loses none, so what is broadcast is bounded.

A phrase is scored at its weakest cut in two: score = floor(SCORE * a / (l + r)), where a is its count and l and r are
those of both parts. Phrases that stand inside a longer one nearly as often as anywhere are dropped.

Defined cases: a null text counts as empty, a null language as ``und``; only A-Z are lower-cased; n-grams don't reach over a
piece's end; ties of cuts go to the shorter first part, ties of score to the larger count, then to the phrase's bytes;
rows that repeat a doc_id count each; an empty table gives no rows; other columns, whatever their names, are neither read nor
returned. N-grams are told apart by 64-bit hashes within some MB of text, and by their words everywhere else.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, run_hashes, settle, slices, span_hashes, text_of

LEAST, LONGEST, SCORE, SUBSUMED_PERCENT, TOP = 30, 4, 2_000_000, 80, 2000
UNKNOWN = "und"
ROWS, CELL_BYTES = 2, 64
LEAST_BITS, MOST_BITS, BLOCK_BITS, BLOCKS_BITS = 16, 28, 12, 14
#: n-grams that a task sorts together; text that a task looks at together when it counts exactly
BUFFER, SLICE_BYTES = 6 << 20, 4 << 20
#: parts of a language that are ranked by themselves first
RANK_PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[9, 32]] = True


class Phrases:
    """Words of some texts with hashes; n-grams are known by their first word's number."""

    def __init__(self, texts: list[bytes], languages: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        self.data = _LOWER[np.frombuffer(joined, np.uint8)]
        self.inside = ~_OUTSIDE[self.data]
        change = np.diff(self.inside, prepend=False).nonzero()[0]
        self.starts, self.ends = change[::2], change[1::2]
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.piece = np.cumsum(_BREAK[self.data], dtype=np.int32)[self.starts]
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.text = np.searchsorted(text_at, self.starts, side="right") - 1
        self.language = languages.view(np.uint64)[self.text] if len(texts) else np.zeros(0, np.uint64)

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one piece."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        h = run_hashes(self.hashes, at, at + k)
        return mix64(h ^ self.language[:n]), self.piece[:n] == self.piece[k - 1 :]

    @functools.cached_property
    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each begins."""
        data, keep = self.data.copy(), self.inside.copy()
        data[self.ends], keep[self.ends] = 32, True
        return data[keep].tobytes(), np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        """The k words from some words on, with one space between."""
        text, offset = self.spaced
        return [text[a:b] for a, b in zip(offset[at].tolist(), (offset[at + k] - 1).tolist(), strict=True)]


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def stepped(cell: np.ndarray, begins: np.ndarray, counts: np.ndarray, block_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted cells as steps of a byte from one to the next, the first of a block from before its beginning, with their counts; how many
    steps each cell takes. Where a step is longer than a byte, cells with no count stand in between."""
    offset = (cell & np.uint32((1 << block_bits) - 1)).astype(np.int64)
    step = np.diff(offset, prepend=-1)
    step[begins] = offset[begins] + 1
    reps = (step - 1) // 255 + 1
    last = np.cumsum(reps) - 1
    steps, spread = np.full(reps.sum(), 255, np.uint8), np.zeros(reps.sum(), counts.dtype)
    steps[last], spread[last] = step - 255 * (reps - 1), counts
    return steps, spread, reps


def may_be_frequent(hashes: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Whether all the cells' bits are set."""
    out = np.ones(len(hashes), bool)
    for row, bitmap in enumerate(maps):
        cell = cells(hashes, row, (len(bitmap) * 8).bit_length() - 1)
        out &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def likely(p: Phrases, first: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Pairs' hashes, those that may be frequent, and for longer n-grams whether all their pairs may be."""
    h, ok = p.ngrams(2)
    pair = ok.copy()
    pair[ok] = may_be_frequent(h[ok], first)
    longer = {}
    for k in range(3, LONGEST + 1):
        n = len(p.starts) - k + 1
        longer[k] = np.logical_and.reduce([pair[i : i + n] for i in range(k - 1)]) if n > 0 else np.zeros(0, bool)
    return h, pair, longer


def read_slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[pa.RecordBatch, Phrases]]:
    for whole in batches:
        for batch in slices(whole, "text", most_bytes):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield batch, Phrases(texts, batch.column("language").to_numpy())


def sketch(rows: DataFrame, hashes_of: Callable[[Phrases], list[np.ndarray]], bits: int, least: int) -> DataFrame:
    """sketch_row, block, bits: whether each cell of a block reached the least count, merged from all tasks' counts."""
    kind = np.uint8 if least < 256 else np.uint32
    block_bits = max(min(bits, BLOCK_BITS), bits - BLOCKS_BITS)

    def sorted_counts(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        for row in range(ROWS if len(hashes) else 0):
            cell = np.sort(cells(hashes, row, bits))
            at = np.flatnonzero(np.diff(cell, prepend=cell[0] ^ 1))
            counts = np.minimum(np.diff(at, append=len(cell)), least).astype(kind)
            cell = cell[at]
            block = cell >> block_bits
            begins = np.flatnonzero(np.diff(block, prepend=block[0] ^ 1))
            steps, counts, reps = stepped(cell, begins, counts, block_bits)
            bounds = np.append(0, np.cumsum(np.add.reduceat(reps, begins))).astype(np.int32)

            def packed(values: np.ndarray, bounds: np.ndarray = bounds) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * np.int32(values.itemsize)), pa.py_buffer(values)])

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begins), row, np.int32)), pa.array(block[begins].astype(np.int32)), packed(steps), packed(counts)], ["sketch_row", "block", "steps", "counts"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, p in read_slices(batches, 512 << 10):
            new = hashes_of(p)
            held += new
            n += sum(map(len, new))
            if n >= BUFFER:
                yield from sorted_counts(held)
                held, n = [], 0
        yield from sorted_counts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = np.zeros(1 << block_bits, np.int64), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"sketch_row": pa.array([here[0]], pa.int32()), "block": pa.array([here[1]], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_row", "block", "steps", "counts"))
            for row, block, steps, counts in zip(*columns, strict=True):
                if here != (row, block):
                    if here is not None:
                        yield done()
                    here, total[:] = (row, block), 0
                total[np.cumsum(np.frombuffer(steps, np.uint8), dtype=np.int64) - 1] += np.frombuffer(counts, kind)  # cells of a message differ
        if here is not None:
            yield done()

    counted = rows.mapInArrow(count, "sketch_row int, block int, steps binary, counts binary")
    by_block = counted.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block")
    return by_block.mapInArrow(merge, "sketch_row int, block int, bits binary")


def bitmaps(merged: DataFrame, bits: int) -> list[np.ndarray]:
    """The bits of each row of a sketch, folded to MOST_BITS cells at most: what the driver and all tasks hold is bounded."""
    kept = min(bits, MOST_BITS)
    out = [np.zeros(max(1, (1 << kept) // 8), np.uint8) for _ in range(ROWS)]
    block_bytes = max(1, (1 << max(min(bits, BLOCK_BITS), bits - BLOCKS_BITS)) // 8)
    for r in merged.collect() if bits <= MOST_BITS else merged.toLocalIterator():
        at = r["block"] * block_bytes % len(out[0])
        out[r["sketch_row"]][at : at + block_bytes] |= np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f of every n-gram of up to LONGEST words with f >= least; lang, n), exact counts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text")).withColumn("language", F.xxhash64("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))

    def short(p: Phrases) -> list[np.ndarray]:
        return [h[ok] for h, ok in (p.ngrams(1), p.ngrams(2))]

    first = bitmaps(sketch(rows, short, bits, least), bits)
    first_ = spark.sparkContext.broadcast(first)

    def long(p: Phrases) -> list[np.ndarray]:
        _, _, longer = likely(p, first_.value)
        return [(h := p.ngrams(k))[0][h[1] & ok] for k, ok in longer.items()]

    second = bitmaps(sketch(rows, long, bits, least), bits)
    second_ = spark.sparkContext.broadcast(second)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in read_slices(batches, SLICE_BYTES):
            languages = batch.column("lang").to_pylist()
            pair_hash, pair, longer = likely(p, first_.value)
            one, _ = p.ngrams(1)
            found = [(1, one, np.flatnonzero(may_be_frequent(one, first_.value))), (2, pair_hash, np.flatnonzero(pair))]
            for k, ok in longer.items():
                h, inside = p.ngrams(k)
                at = np.flatnonzero(ok & inside)
                found.append((k, h, at[may_be_frequent(h[at], second_.value)]))
            for k, h, at in found:
                _, where, counts = np.unique(h[at], return_index=True, return_counts=True)
                where = at[where]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([languages[i] for i in p.text[where].tolist()], pa.string()),
                        "phrase": pa.array(p.phrases(where, k), pa.binary()).cast(pa.string()),
                        "words": pa.array(np.full(len(where), k, np.int32)),
                        "f": pa.array(counts.astype(np.int64)),
                    }
                )
            words = np.bincount(p.text, minlength=len(languages))
            by_language: dict[str, int] = {}
            for lang, n in zip(languages, words.tolist(), strict=True):
                by_language[lang] = by_language.get(lang, 0) + n
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array(by_language, pa.string()), "phrase": pa.nulls(len(by_language), pa.string()), "words": pa.array([0] * len(by_language), pa.int32()), "f": pa.array(by_language.values(), pa.int64())}
            )

    made = rows.mapInArrow(count, "lang string, phrase string, words int, f long")
    counted = settle(made.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull()), "counted")
    return counted.filter("phrase is not null"), counted.filter("phrase is null").select("lang", F.col("f").alias("n"))


def cut(first: int):
    """The phrase's first words and the rest."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, 1, first), " "), F.array_join(F.slice(words, F.lit(first + 1), F.size(words)), " ")


def scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases of two words and more, at their weakest cut."""
    candidates = counted.filter("words >= 2")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), cut(k)[0].alias("left_part"), cut(k)[1].alias("right_part")) for k in range(1, LONGEST)])
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.inline(F.filter(parts, lambda x: x["k"] < F.col("words"))))
    side = lambda part, name: counted.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    lefts = settle(cuts.join(side("left_part", "l"), ["lang", "left_part"]).drop("left_part"), "cuts")
    both = lefts.join(side("right_part", "r"), ["lang", "right_part"]).drop("right_part")
    score = F.expr(f"cast({SCORE} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").alias("score")
    weakest = settle(both.select("lang", "phrase", "words", "a", "k", "l", "r", score), "scores").groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return weakest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_subsumed(candidates: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """The candidates that stand in no longer phrase with at least so many percent of their count."""
    words = F.split("phrase", " ")
    inner = F.array(*[F.when(F.lit(i + k) <= F.col("words"), F.array_join(F.slice(words, i + 1, k), " ")) for k in range(2, LONGEST) for i in range(LONGEST - k + 1)])
    within = counted.filter("words >= 3").select("lang", "phrase", "words", "f", F.explode(F.filter(inner, lambda x: x.isNotNull() & (x != F.col("phrase")))).alias("inner"))
    longest = settle(within.groupBy("lang", "inner").agg(F.max("f").alias("longer")).withColumnRenamed("inner", "phrase"), "within")
    joined = candidates.join(longest, ["lang", "phrase"], "left")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return joined.filter(F.col("longer").isNull() | (100 * big("longer") < percent * big("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first of each language's phrases."""
    counted, words = frequent_phrases(docs, least)
    kept = not_subsumed(scored(counted), counted, percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a language may hold any part of the rows: its parts are ranked first, and only their best meet
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
