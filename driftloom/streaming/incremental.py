"""Incremental runs: new files of a folder are taken in once each, and what they change is brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def each_arrival(spark: SparkSession, folder: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], source_format: str = "parquet") -> None:
    """Runs work(new rows, batch number) on all that has arrived since the last call, then stops.

    The checkpoint folder remembers which files were taken; after a failure the same batch is given again, so work
    should be repeatable for a batch number.
    """
    stream = spark.readStream.schema(schema).format(source_format).load(folder)
    run = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(work).start()
    run.awaitTermination()
