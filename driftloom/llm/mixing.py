"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources in order of code point (null last) get weights in turn;
together they share a fraction of all words by weight, but none more than a multiple of its own words: what
a source cannot take is shared again by weight. With r = target / source words, every document of a source
expects r copies; expected copies are summed along the source in order of size, one random offset is added,
and a copy is emitted for each integer that the sum crosses. Neighbours in size stand for one another, so
that the words taken stay within about one document of the target.

The prefix sums are exact and distributed: rows are dealt by range of (source, size, doc_id) and counted
by piece of a source; a source may hold any part of the rows.

Defined cases: null or empty texts have size 0 and take nothing; null is a source of its own; a source
without words has target 0; ties in size go by doc_id (null first), and rows that repeat a doc_id and size
are interchangeable; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, numbered, row_column, settle, text_of

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20240601


def offset(seed: int = SEED) -> float:
    """The random offset, in thousandths so that SQL and Spark read the same number."""
    return random.Random(seed).randrange(1, 1000) / 1000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. Works on one row per source: a source is full when the level reaches
    most * size / weight; in that order, running sums give the level at which all words are shared."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if this source and all after it stay open: too high for full sources, falling from the true one on
    levels = weighed.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - filled) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_rows)
    target = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, number: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row. number: the column of the rows' numbers, which are returned too (row_)."""
    spark = docs.sparkSession
    row = ["row_"] if number else []
    sizes = docs.select(*row_column(number), "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = settle(sizes, "sizes")  # dealing by range reads its input twice: texts are counted once
    dealt = settle(sizes.repartitionByRange(pieces, "source", "size", "doc_id", *row).withColumn("piece", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("source", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s"), F.col("piece").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    here = Window.partitionBy("piece", "source").orderBy("size", "doc_id", *row)
    targets = source_targets(dealt, weights, share, most).withColumnRenamed("source", "t")
    ranked = dealt.withColumn("rank", F.row_number().over(here))
    joined = ranked.join(starts, (F.col("piece") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    joined = joined.join(targets, F.col("source").eqNullSafe(F.col("t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = joined.select(*row, "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), (F.col("start") + F.col("rank")).alias("rank"))
    up_to = lambda rank: F.floor(F.lit(offset(seed)) + rank * F.col("rate"))
    copies = (up_to(F.col("rank")) - up_to(F.col("rank") - 1)).cast("int")
    return at.withColumn("copies", copies).select(*row, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken itself."""
    rows, row = numbered(docs)
    picked, copies = free_name(rows, "picked_"), free_name(rows, "copies_")
    picks = mix(rows, number=row, **options).filter("copies > 0").select(F.col("row_").alias(picked), F.col("copies").alias(copies))
    found = rows.join(picks, F.col(row) == F.col(picked))
    return found.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
