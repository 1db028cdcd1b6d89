"""Metadata documents: one JSON document for each artefact, read as tables of methods, links and recorded versions.

A version is a JSON string for a scalar, an object keyed by index parts for a vector (nested by dimension), or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
LINK = "array<struct<path: string, version: string>>"
SCHEMA = (
    "format int, tracked boolean, kind string, command string, working_dir string, output_index int, signature string, clean_outputs boolean,"
    f" resource_groups array<string>, success_codes array<int>, inputs {LINK}, outputs {LINK}"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their file; a format other than 1 is an error."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    bad = F.raise_error(F.concat(F.lit("unsupported metadata format "), F.coalesce(F.col("format").cast("string"), F.lit("(none)"))))
    return rows.withColumn("format", F.when(F.col("format") == FORMAT, F.col("format")).otherwise(bad)).withColumn("file", F.col("_metadata.file_path"))


def write(documents: DataFrame, path: str) -> None:
    """A file for each document. Tasks put their files in place themselves: at the job's end the driver would move them one by one."""
    in_tasks = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
    documents.select(F.lit(FORMAT).alias("format"), *[c for c in documents.columns if c not in ("format", "file")]).write.mode("overwrite").option("maxRecordsPerFile", 1).option(*in_tasks).json(path)


def links(documents: DataFrame) -> DataFrame:
    """method, role, port, artefact, version (JSON): ports count from 1. A method is named by its smallest output."""
    method = F.array_min(F.transform("outputs", lambda o: o["path"])).alias("method")
    sides = [documents.select(method, F.lit(role).alias("role"), F.posexplode(side).alias("port", "link")) for role, side in (("in", "inputs"), ("out", "outputs"))]
    both = sides[0].union(sides[1])
    return both.select("method", "role", (F.col("port") + 1).alias("port"), F.col("link.path").alias("artefact"), F.col("link.version").alias("version")).distinct()


def flattened(rows: DataFrame, version: str, rank: int) -> DataFrame:
    """One row for each element of a version (JSON text) of some rank: index, value. Empty objects give no rows."""
    out = rows.withColumn("index", F.array().cast("array<string>")).withColumn("value", F.col(version))
    for _ in range(rank):
        parsed = F.from_json("value", "map<string,string>")
        out = out.select(*[c for c in out.columns if c not in ("index", "value")], "index", F.explode(parsed).alias("part", "value"))
        out = out.withColumn("index", F.concat("index", F.array("part"))).drop("part")
    return out


def packed(value: Column, index: Column, rank: int) -> Column:
    """Aggregate for scalars and vectors of one dimension: the version as JSON text."""
    if rank == 0:
        return F.first(value)
    if rank == 1:
        return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(index[0], value)))))
    raise ValueError("pack the innermost dimension first")
