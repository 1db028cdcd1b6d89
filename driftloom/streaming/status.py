"""States of elements while versions arrive: what is expected of an element, what is there and what is stored, kept by element.

``follow`` takes a stream of reports (element, kind, version), kind being expected, actual or stored, and gives the element's status after each
batch that changes it, by the rules of ``operators.staleness.link_status``. Reports may come in any order and in any batches: the last of
each kind counts, by its number (seq); a null version says that there is none any more. A stored report says that a store holds that version;
it counts as long as the element expects it, and is kept for as many versions as were reported stored.

Defined cases: an element that was only reported stored has no status yet; a report that repeats what is known changes nothing and
gives no row; of reports with the same number the larger version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staleness import link_status

REPORT = "element string, kind string, version string, seq long"
STATUS = "element string, expected string, actual string, status string, turn long"


def states(reports: DataFrame) -> DataFrame:
    """element, expected, actual, status of the elements that a batch reports on, as they are after it. What is known of an element is kept by built-in
    aggregates in the state store: no element goes to Python. States are kept by RocksDB."""
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind, report = F.col("kind"), F.struct("seq", "version")
    known = reports.groupBy("element").agg(
        F.max(F.when(kind == "expected", report)).alias("expects"),
        F.max(F.when(~kind.isin("expected", "stored"), report)).alias("holds"),
        F.collect_set(F.when(kind == "stored", F.col("version"))).alias("stored"),
    )
    known = known.filter("expects is not null or holds is not null")
    known = known.select("element", F.col("expects.version").alias("expected"), F.col("holds.version").alias("actual"), F.array_contains("stored", F.col("expects.version")).alias("in_store"))
    return known.select("element", "expected", "actual", link_status(known).alias("status"))


def changed(rows: DataFrame, before: DataFrame) -> DataFrame:
    """STATUS, of the elements whose state isn't what the changes before (STATUS) say; turn counts an element's changes."""
    last = before.groupBy("element").agg(F.max(F.struct("turn", "expected", "actual", "status")).alias("was"))
    both = rows.join(last, "element", "left")
    same = F.col("was").isNotNull()
    for c in ("expected", "actual", "status"):
        same = same & F.col(c).eqNullSafe(F.col(f"was.{c}"))
    return both.filter(~same).select("element", "expected", "actual", "status", (F.coalesce("was.turn", F.lit(0)) + 1).cast("long").alias("turn"))


def follow(reports: DataFrame, checkpoint: str, out: str) -> None:
    """Takes in what has arrived since the last call and appends the changes of state to a table; then stops. A batch that is given again
    after a failure is written to the same place. Each batch reads the changes of those before it."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema(f"{STATUS}, batch long").parquet(out).filter(F.col("batch") < batch) if batch else spark.createDataFrame([], STATUS)
        changed(rows, before).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    states(reports).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def latest(changes: DataFrame) -> DataFrame:
    """element, expected, actual, status as they are now, from all changes so far."""
    last = changes.groupBy("element").agg(F.max_by(F.struct("expected", "actual", "status"), "turn").alias("last"))
    return last.select("element", "last.*")
