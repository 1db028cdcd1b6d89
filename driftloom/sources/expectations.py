"""Recorded versions on disk: what methods saw of their elements, in buckets that are rewritten one by one.

A row belongs to the bucket of its method, the first part of its instance and, so that an instance part that holds most rows is spread, one of
``SALTS`` numbers from the rest of the instance. An update rewrites the buckets of the instances that it touches, by dynamic
partition overwrite, and no others; elements that stand together change together, so these are few. The number of buckets is fixed when
the table is made.

Defined cases: a table that isn't there is empty; the rows of touched instances are replaced as a whole, also by none; a bucket without
rows keeps one marking row. A job that fails while it rewrites leaves each bucket as it was or as it should be; the next update of the
same instances mends the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .roots import filesystem
from .tables import settle

SCHEMA = "method string, role string, port int, instance array<string>, index array<string>, expected string"
BUCKETS, SALTS = 512, 4


class Expectations:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        from pyarrow.fs import FileType

        self.spark, self.folder = spark, folder.rstrip("/")
        system, base = filesystem(self.folder)
        if system.get_file_info(f"{base}/table.json").type == FileType.NotFound:
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/table.json") as out:
                out.write(json.dumps({"buckets": buckets}).encode())
        with system.open_input_stream(f"{base}/table.json") as source:
            self.buckets = json.loads(source.read())["buckets"]

    def _there(self) -> bool:
        from pyarrow.fs import FileType

        system, base = filesystem(self.folder)
        return system.get_file_info(f"{base}/rows").type != FileType.NotFound

    def bucket(self, method: Column, instance: Column) -> Column:
        first = F.xxhash64(method, F.try_element_at(instance, F.lit(1)))
        salt = F.pmod(F.xxhash64(F.slice(instance, 2, F.greatest(F.size(instance), F.lit(1)))), F.lit(SALTS))
        return F.pmod(F.xxhash64(first, salt), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.folder}/rows")

    def read(self) -> DataFrame:
        return self._all().filter("method is not null").drop("bucket")

    def replace(self, touched: DataFrame, rows: DataFrame) -> int:
        """Puts the rows in the place of all that is recorded of the touched instances (method, instance); returns how many buckets were
        rewritten."""
        touched = settle(touched.select("method", "instance").distinct())
        ids = [r[0] for r in touched.select(self.bucket(F.col("method"), F.col("instance"))).distinct().collect()]  # as many as buckets, at most
        if not ids:
            return 0
        old = self._all().filter(F.col("bucket").isin(ids)).filter("method is not null").drop("bucket").join(touched, ["method", "instance"], "left_anti")
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        new = old.select(columns).union(rows.join(touched, ["method", "instance"], "left_semi").select(columns))
        placed = new.withColumn("bucket", self.bucket(F.col("method"), F.col("instance")))
        marks = self.spark.createDataFrame([(i,) for i in ids], "bucket int").select(*[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")], "bucket")
        placed = settle(placed.union(marks)).repartition("bucket")  # written from a checkpoint: the files read aren't those written
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        return len(ids)
