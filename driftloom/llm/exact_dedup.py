"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash.

Texts are equal when they are identical after deleting white space. The first scan makes lengths and
prefix hashes, and only those are shuffled; rows alone with their length, or with their length and
prefix, are unique. Whole texts are hashed for the surviving groups only, where they are read: text is
never shuffled. Lengths and groups form by partial aggregation and are written; rows then meet their group's
row in a join with shuffles of its own, which adaptive execution splits, so that a group may hold any part of the rows.

Defined cases: a null text counts as empty; all-white-space texts equal the empty one; of equal texts
the row with most code points in the original, then the smallest doc_id, stays (null doc_ids last);
rows that repeat a doc_id are judged each by its own text, so repeats of the row that stays are marked as kept
too (``keep_one_of_each_text`` goes by row and keeps one of them); an empty table gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, numbered, row_column, settle, text_of, without_ids

#: code points of the normalised text that the second step hashes
PREFIX = 128
#: surviving (length, prefix) keys that are broadcast at most, 16 bytes each; more are joined by shuffle
BROADCAST_KEYS = 1 << 19


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def surviving(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, chars, text_sha256 of the rows that share length and prefix with another. row: the column of their numbers, which are
    returned too (row_)."""
    number = row_column(row)
    length = F.char_length(normalised(text_of())).alias("length")
    prefix = F.xxhash64(F.substring(normalised(text_of()), 1, PREFIX)).alias("prefix")
    signs = settle(docs.select(length, prefix), "signs")
    by_length = settle(signs.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length"), "lengths")
    if by_length.count() <= BROADCAST_KEYS:
        by_length = F.broadcast(by_length)
    crowded = signs.join(by_length, "length", "left_semi")
    keys = settle(crowded.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("length", "prefix"), "keys")
    scan = docs.select(*number, "doc_id", F.char_length(text_of()).alias("chars"), length, prefix, text_of().alias("text"))
    digest, names = text_digest(F.col("text")).alias("text_sha256"), ["row_"] if row else []
    if keys.count() <= BROADCAST_KEYS:
        return scan.join(F.broadcast(keys), ["length", "prefix"], "left_semi").select(*names, "doc_id", "chars", digest)
    return scan.select(*names, "doc_id", "chars", "length", "prefix", digest).join(keys, ["length", "prefix"], "left_semi").drop("length", "prefix")


def duplicate_groups(survivors: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size of every text that at least two surviving rows have; keep_row too if they are numbered."""
    row = [c for c in survivors.columns if c == "row_"]
    return (
        survivors.groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *row)).alias("best"),
            F.count("*").alias("group_size"),
        )
        .filter("group_size > 1")
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", *[F.col("best.row_").alias("keep_row") for _ in row])
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    groups = settle(duplicate_groups(surviving(docs)), "groups")
    rows = docs.select("doc_id", text_digest(text_of()).alias("text_sha256"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one_of_each_text(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    rows, row = numbered(docs)
    survivors = settle(surviving(rows, row), "survivors")
    groups = settle(duplicate_groups(survivors), "groups")
    dropped = survivors.select("row_", "text_sha256").join(groups, "text_sha256").filter("row_ <> keep_row").select("row_")
    return without_ids(rows, row, settle(dropped, "dropped")).drop(row)
