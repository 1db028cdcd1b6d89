"""Tables by name from a folder of Parquet files, and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is configured."""
    context = spark.sparkContext
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that doesn't exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small iterative table through a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """A large table written as Parquet to the cluster's shared folder, and its place: filters on a range skip what they can't match."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by columns to tasks that work on files. The number of tasks is given: by the rows' bytes, which say little of the
    work, adaptive execution would put some ten thousand names into one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *columns)
