"""Substring dedup by De Bruijn compaction: long word sequences that an earlier document has are removed.

A window is ``WINDOW`` consecutive words. Every window holds a minimiser: the leftmost of its ``K``-word runs with the
smallest hash; equal windows hold equal ones at equal places. Minimisers that documents share are the nodes
of a graph, and two that follow one another at most ``K`` words apart are an edge, whose words the two nodes
determine. Where each occurrence of a node is followed by the same node at the same distance, and each
occurrence of that node preceded by the first, the path doesn't branch; such paths are compacted, through
joins of the nodes' statistics with their occurrences. All occurrences of a path have the same words, so a
window inside a path repeats exactly where the path does. That is verified at the source: a path of a window or
more is read at each occurrence's coordinates, and occurrences are the same only if digests of all their words are.
Windows that reach over a path's end are compared by their own hash, taken there too. A word goes if a window
that covers it also starts in a document with a smaller doc_id.

Whole copies (equal sequences of words) are settled beforehand, so that large groups of copies bring one document into
the graph. What is known of a node or hash is written before it is joined with its occurrences: the join then
has shuffles of its own, whose hot keys adaptive execution splits. Hashes have 64 bits; rows carry coordinates only, and texts meet coordinates twice, only those
of documents with shared minimisers.

Defined cases: words are maximal runs of characters other than ``[\\x20\\x09-\\x0D]``, unchanged; null text has none, and a
text of less than a window loses none; doc_ids are integers (others are an error), a null one counts as larger than all
others, and so does 2 ** 63 - 1, which is reserved for it; rows that repeat a
doc_id don't remove one another's words; an empty table gives no rows; other columns are neither
read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, joined_words, run_hashes, runs_of, settle, slices, with_ids

WINDOW, K = 50, 26
RUN = WINDOW - K + 1  # K-word runs of a window
NO_ID = (1 << 63) - 1


def sequence_tags(words: Words) -> np.ndarray:
    """A number for each text's sequence of words."""
    h = run_hashes(words.hashes, words.word_at[:-1], words.word_at[1:]) if len(words.hashes) else np.zeros(len(words.word_at) - 1, np.uint64)
    return (h >> np.uint64(1)).astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number for each row), doc (the doc_id, or the largest number), text; written, so that a row's number stays."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    return settle(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def whole(rows: DataFrame) -> DataFrame:
    """row, doc, sequence, n_words, sha256 of the words joined by spaces, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, "text"):
                words = Words(batch.column("text"))
                shas = [hashlib.sha256(x).hexdigest() for x in joined_words(words, np.ones(len(words.starts), bool))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc"), pa.array(sequence_tags(words)), pa.array(words.counts().astype(np.int64)), pa.array(shas, pa.string())], ["row", "doc", "sequence", "n_words", "sha"]
                )

    return rows.mapInArrow(run, "row long, doc long, sequence long, n_words long, sha string")


def minimisers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of the runs of K words that are the minimiser of a window."""
    h, text, at = runs_of(words, K)
    n = len(h) - RUN + 1
    if n <= 0:
        return h[:0], text[:0], at[:0]
    least = np.arange(n) + np.lib.stride_tricks.sliding_window_view(h, RUN).argmin(axis=1)
    inside = text[:n] == text[RUN - 1 :]
    chosen = np.unique(least[inside])
    return h[chosen], text[chosen], at[chosen]


def node_rows(rows: DataFrame) -> DataFrame:
    """kmer, doc, row, at (the first word's position) of every minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, "text"):
                words = Words(batch.column("text"))
                h, text, at = minimisers(words)
                of_text = [batch.column(c).take(pa.array(text)) for c in ("doc", "row")]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *of_text, pa.array(at.astype(np.int32))], ["kmer", "doc", "row", "at"])

    return rows.mapInArrow(run, "kmer long, doc long, row long, at int")


def shared(nodes: DataFrame) -> DataFrame:
    """The occurrences of minimisers that at least two documents have."""
    several = nodes.groupBy("kmer").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("kmer")
    return nodes.join(settle(several, "several"), "kmer")


def compacted(occurrences: DataFrame) -> DataFrame:
    """row, start, end: occurrences of non-branching paths, as word spans."""
    line = Window.partitionBy("row").orderBy("at")
    edge = lambda other, gap: F.when(gap <= K, F.xxhash64(other, gap))
    rows = settle(
        occurrences.select(
            "kmer",
            "row",
            "at",
            edge(F.lead("kmer").over(line), F.lead("at").over(line) - F.col("at")).alias("after"),
            edge(F.lag("kmer").over(line), F.col("at") - F.lag("at").over(line)).alias("before"),
        ),
        "edges",
    )
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    branching = rows.groupBy("kmer").agg(one("after").alias("one_after"), one("before").alias("one_before"))
    marked = rows.join(settle(branching, "branching"), "kmer")
    goes_on = F.coalesce(F.col("one_before") & F.lag("one_after").over(line), F.lit(False))
    paths = marked.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("begins").over(line))
    return paths.groupBy("row", "path").agg(F.min("at").alias("start"), (F.max("at") + K).alias("end")).drop("path")


def at_source(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """hash, doc, row, start, size (in words), read from the texts: paths of at least a window, by a digest of their words,
    and the windows that share at least K words with a path but are inside none."""

    def digest(words: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, "text"):
                words = Words(batch.column("text"))
                docs, numbers = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
                texts, word_ends = joined_words(words, np.ones(len(words.starts), bool)), np.cumsum(words.ends - words.starts + 1)
                for i, paths in enumerate(batch.column("spans").to_pylist()):
                    first, last = words.word_at[i], words.word_at[i + 1]
                    n = last - first - WINDOW + 1
                    if n <= 0:
                        continue
                    some, inside = np.zeros(n, bool), np.zeros(n, bool)
                    for p in paths:
                        some[max(0, p["start"] - (WINDOW - K)) : max(0, p["end"] - K + 1)] = True
                        inside[p["start"] : max(p["start"], p["end"] - WINDOW + 1)] = True
                    at = np.flatnonzero(some & ~inside)
                    h = run_hashes(words.hashes[first:last], at, at + WINDOW).view(np.int64)
                    of_word = np.concatenate([[0], word_ends[first:last] - (word_ends[first - 1] if first else 0)])
                    long = [(p["start"], p["end"]) for p in paths if p["end"] - p["start"] >= WINDOW]
                    digests = [digest(texts[i][of_word[a] : of_word[b] - 1]) for a, b in long]
                    start = np.concatenate([at, np.array([a for a, _ in long], np.int64)])
                    size = np.concatenate([np.full(len(at), WINDOW), np.array([b - a for a, b in long], np.int64)])
                    columns = {"hash": np.concatenate([h, np.array(digests, np.int64)]), "doc": np.full(len(start), docs[i]), "row": np.full(len(start), numbers[i]), "start": start, "size": size}
                    yield pa.RecordBatch.from_pydict({name: pa.array(c, pa.int64()) for name, c in columns.items()})

    of_row = settle(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    texts = with_ids(rows, "row", of_row.select("row"))
    return texts.join(of_row, "row").mapInArrow(run, "hash long, doc long, row long, start long, size long")


def removed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """row, n_removed, sha of the rows with ranges (row, start, end) of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, "text"):
                words = Words(batch.column("text"))
                gone = np.zeros(len(words.starts) + 1, np.int64)
                for i, parts in enumerate(batch.column("ranges").to_pylist()):
                    for r in parts:
                        gone[words.word_at[i] + r["start"]] += 1
                        gone[words.word_at[i] + r["end"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(~keep)])
                n = np.diff(left[words.word_at])
                shas = [hashlib.sha256(x).hexdigest() for x in joined_words(words, keep)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n.astype(np.int64)), pa.array(shas, pa.string())], ["row", "n_removed", "new_sha"])

    of_row = settle(ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    texts = with_ids(rows, "row", of_row.select("row"))
    return texts.join(of_row, "row").mapInArrow(run, "row long, n_removed long, new_sha string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows = numbered(docs)
    known = settle(whole(rows), "rows")
    firsts = known.groupBy("sequence").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("sequence", "first")
    firsts = settle(firsts, "firsts")
    copies = settle(known.join(firsts, "sequence").filter(F.col("doc") > F.col("first")).select("row"), "copies")
    found = settle(shared(settle(node_rows(rows), "nodes")), "shared")
    single = found.join(copies, "row", "left_anti")
    spans = settle(compacted(shared(settle(single, "single"))), "paths")
    read = settle(at_source(rows, spans), "source")
    repeated = read.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("hash", "least")
    late = read.join(settle(repeated, "repeated"), "hash").filter("doc > least")
    changed = removed(rows, late.select("row", "start", (F.col("start") + F.col("size")).alias("end")))
    out = known.join(changed, "row", "left").join(copies.withColumn("copy", F.lit(True)), "row", "left")
    whole_gone = F.col("copy").isNotNull() & (F.col("n_words") >= WINDOW)
    return out.select(
        F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"),
        "n_words",
        F.when(whole_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
    )
