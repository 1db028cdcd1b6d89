"""Dataflow over indexed collections in long form: one row per element, index parts in columns.

All operators are joins, groupings and generators that Catalyst plans; indices are ordinary columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

PROCESS, DELETE = "Process", "Delete"


def map_elements(elements: DataFrame, index: list[str], **outputs: Column) -> DataFrame:
    """One output element for each input element."""
    return elements.select(*index, *[c.alias(name) for name, c in outputs.items()])


def with_scalar(elements: DataFrame, scalar: DataFrame, name: str) -> DataFrame:
    """Every element with the value of a one-row, one-column DataFrame (a scalar subquery: more rows are an error)."""
    return elements.withColumn(name, scalar.scalar())


def with_partial(elements: DataFrame, lower: DataFrame, prefix: list[str]) -> DataFrame:
    """Every element with the element of lower rank that its index begins with."""
    return elements.join(lower, prefix)


def aligned(left: DataFrame, right: DataFrame, index: list[str]) -> DataFrame:
    """Elements of both collections by equal index."""
    return left.join(right, index)


def scatter(elements: DataFrame, index: list[str], parts: Column, position: str, value: str) -> DataFrame:
    """An element for each entry of an array; its position extends the index, counted from 0."""
    return elements.select(*index, F.posexplode(parts).alias(position, value))


def scatter_ports(elements: DataFrame, index: list[str], ports: dict[str, Column]) -> DataFrame:
    """Several output collections of one pass: (index, port, value)."""
    rows = F.array(*[F.struct(F.lit(port).alias("port"), value.alias("value")) for port, value in ports.items()])
    return elements.select(*index, F.inline(rows))


def reduce_to(elements: DataFrame, prefix: list[str], order: str, value: str, name: str, separator: str = "") -> DataFrame:
    """Values of a vector joined in the order of the dropped index part."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return elements.groupBy(*prefix).agg(F.array_join(F.transform(ordered, lambda x: x[value]), separator).alias(name))


def fold_level(elements: DataFrame, prefix: list[str], **folds: Column) -> DataFrame:
    """Elements whose values are summed up over the last dimension by built-in aggregates: nothing is gathered, tasks sum up before they
    shuffle, and the result is a vector of the rank before that can be folded again."""
    return elements.groupBy(*prefix).agg(*[c.alias(name) for name, c in folds.items()])


def reduce_level(elements: DataFrame, rank: int, value: str, parents: DataFrame | None = None) -> DataFrame:
    """index (one part shorter), values: the last dimension of a vector of some rank gathered in order of its index parts, as an array of
    (key, value). parents: indices of what is there without elements, which gets an empty array.

    An index of another length is an error: levels that mix values and vectors have no order. A value should be small (a version, a
    path, a number): contents of elements are joined when they are needed.
    """
    right = F.size("index") == rank
    error = F.raise_error(F.concat(F.lit("a ragged vector: "), F.array_join("index", "/"), F.lit(f" among indices of {rank} parts")))
    index = F.when(right, F.col("index")).otherwise(error.cast("array<string>"))
    rows = elements.select(index.alias("index"), F.col(value).alias("value"))
    last = F.element_at("index", rank).alias("key")
    grouped = rows.select(F.slice("index", 1, rank - 1).alias("index"), F.struct(last, "value").alias("pair")).groupBy("index").agg(F.array_sort(F.collect_list("pair")).alias("values"))
    if parents is None:
        return grouped
    every = parents.select("index").distinct().join(grouped, "index", "full_outer")
    none = F.array().cast(grouped.schema["values"].dataType)
    return every.select("index", F.coalesce("values", none).alias("values"))


def scatter_table(elements: DataFrame, index: list[str], order: str, value: str, function: Callable[[str], list[str]]) -> DataFrame:
    """index, position, piece: a table function over partitions by index. It sees a partition's values in an order, one at a time, and
    counts the pieces that the function makes of them on through the whole partition. The schema comes from the table's."""
    from pyspark.sql.functions import udtf

    class Pieces:
        @staticmethod
        def analyze(rows: AnalyzeArgument, *_: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f for f in rows.dataType.fields}
            fields = [StructField(c, kinds[c].dataType) for c in index]
            return AnalyzeResult(StructType([*fields, StructField("position", LongType()), StructField("piece", StringType())]))

        def __init__(self) -> None:
            self.n = 0

        def eval(self, row) -> Iterator[tuple]:
            for piece in function(row[value]) if row[value] is not None else []:
                yield (*[row[c] for c in index], self.n, piece)
                self.n += 1

    rows = elements.select(*dict.fromkeys([*index, order, value])).asTable()
    return udtf(Pieces)(rows.partitionBy(*index).orderBy(order))


def without(elements: DataFrame, keys: DataFrame, index: list[str]) -> DataFrame:
    """The elements but those at some indices; indices that hold nothing make no difference."""
    return elements.join(keys.select(*index).distinct(), index, "left_anti")


def same_rank(elements: DataFrame, index: str) -> DataFrame:
    """The elements; an error if their indices differ in length."""
    ranks = elements.agg(F.count_distinct(F.size(index)).alias("ranks"))
    check = F.when(ranks.scalar() > 1, F.raise_error(F.lit("elements of different rank in one collection"))).otherwise(F.lit(True))
    return elements.filter(check)


def at_prefix(elements: DataFrame, wanted: DataFrame, index: str = "index") -> DataFrame:
    """Elements whose index agrees with a wanted index as far as both reach (a shorter wanted index gets the whole part)."""
    e, w = elements.alias("e"), wanted.withColumnRenamed(index, "wanted").alias("w")
    lengths = [r[0] for r in wanted.select(F.size(index)).distinct().collect()]  # ranks: a handful
    mine = [r[0] for r in elements.select(F.size(index)).distinct().collect()]
    out = None
    for a in sorted(set(lengths)):
        for b in sorted(set(mine)):
            k = min(a, b)
            part = e.filter(F.size(index) == b).withColumn("key", F.slice(index, 1, k)).join(w.filter(F.size("wanted") == a).withColumn("key", F.slice("wanted", 1, k)), "key").drop("key")
            out = part if out is None else out.union(part)
    return out if out is not None else e.join(w, F.lit(False))


def source_delta(expected: DataFrame, actual: DataFrame, index: list[str], artefact: list[str]) -> DataFrame:
    """Expected and actual versions by index, and what is to be done with each element.

    An element on disk is processed; one that is expected only is deleted, unless nothing of its artefact is on disk:
    then all of it is processed, in the hope that it can be restored.
    """
    both = expected.join(actual, index, "full_outer")
    present = actual.filter("actual is not null").select(*artefact).distinct().withColumn("any_actual", F.lit(True))
    joined = both.join(present, artefact, "left")
    update = F.when(F.col("actual").isNotNull() | F.col("any_actual").isNull(), PROCESS).otherwise(DELETE)
    return joined.select(*index, "expected", "actual", update.alias("update_type"))


def propagate_deletes(inputs: DataFrame, index: list[str]) -> DataFrame:
    """Update type of each instance: Delete if any input at its index is to be deleted."""
    return inputs.groupBy(*index).agg(F.when(F.bool_or(F.col("update_type") == DELETE), DELETE).otherwise(PROCESS).alias("update_type"))


def reduce_update(inputs: DataFrame, prefix: list[str]) -> DataFrame:
    """Update type of reduced elements: a reduction is processed again, also when elements went; empty ones are an error upstream."""
    left = F.count_if(F.col("update_type") == PROCESS)
    return inputs.groupBy(*prefix).agg(left.alias("remaining"), F.lit(PROCESS).alias("update_type"))
