"""Content stores: contents by version in any folder that Spark reaches, kept as a log of manifests.

A save writes the contents that the store lacks to a folder of its own, in partitions by the version's beginning, and then adds a manifest
that names this folder. Manifests are numbered without gaps; the number is taken by a rename that fails if the name is taken, so that
of two saves that meet one tries again with the next number: neither is lost, and nothing that stands is written again. The store's
state is what its manifests add and don't remove. ``compact`` puts the contents of many small folders into one and removes them in
one manifest; folders that are no longer named stay until ``vacuum``, for readers that began before.

A directory is stored by its digest: a row for each path inside it, with the version of the file there; the files' contents are stored like
all others, so that what directories share is held once. Both are named by one manifest.

Defined cases: a store without manifests is empty; contents saved twice at a time are held twice and read once; null versions and null contents
aren't stored; a folder that was written by a job that failed is never named.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .roots import filesystem

SCHEMA = "version string, content binary, path string, part string, batch string, shard string"
#: version of a file, or a directory, that holds nothing
EMPTY = hashlib.sha512(b"").hexdigest().upper()
#: hexadecimal digits of a version that name its partition, fixed when a store is made
DIGITS = 1
#: attempts to take the next number before giving up
ATTEMPTS = 100
#: manifests before one of them sums up all before it
SUMMED = 50


class Conflict(RuntimeError):
    """What this manifest removes was removed by another one meanwhile."""


class ContentStore:
    def __init__(self, spark: SparkSession, folder: str, digits: int = DIGITS):
        self.spark, self.folder = spark, folder.rstrip("/")
        system, base = filesystem(self.folder)
        if system.get_file_info(f"{base}/store.json").is_file:
            with system.open_input_stream(f"{base}/store.json") as source:
                digits = json.loads(source.read())["digits"]
        self.digits = digits

    # -- the log

    def _numbers(self) -> list[int]:
        from pyarrow.fs import FileSelector

        system, base = filesystem(self.folder)
        found = system.get_file_info(FileSelector(f"{base}/log", allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        system, base = filesystem(self.folder)
        with system.open_input_stream(f"{base}/log/{number:020d}.json") as source:
            return json.loads(source.read())

    def state(self) -> tuple[int, list[str]]:
        """(the last manifest's number, -1 without any; names of the data folders that count)."""
        numbers = self._numbers()
        later, live = [], []
        for n in reversed(numbers):
            manifest = self._manifest(n)
            later.append(manifest)
            if "all" in manifest:
                break
        for manifest in reversed(later):
            live = manifest.get("all", live)
            live = [x for x in live if x not in manifest["remove"]] + manifest["add"]
        return (numbers[-1] if numbers else -1), live

    def _take(self, number: int, manifest: dict) -> bool:
        """Writes a manifest under a number; False if it is taken."""
        system, base = filesystem(self.folder)
        system.create_dir(f"{base}/log", recursive=True)
        if number == 0:
            with system.open_output_stream(f"{base}/store.json") as out:
                out.write(json.dumps({"digits": self.digits}).encode())
        draft, name = f"{base}/log/{uuid.uuid4().hex}.draft", f"{base}/log/{number:020d}.json"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        try:
            if system.type_name == "local":
                os.link(draft, name)  # fails if the name is taken, also where a rename wouldn't
            else:
                context = self.spark.sparkContext._jvm.org.apache.hadoop
                path = context.fs.Path(f"{self.folder}/log/{number:020d}.json")
                files = context.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = context.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(context.fs.Options.Rename, 1)
                options[0] = none
                files.rename(context.fs.Path(f"{self.folder}/log/{draft.rpartition('/')[2]}"), path, options)
                return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            if system.get_file_info(draft).is_file:
                system.delete_file(draft)
        return True

    def commit(self, add: list[str], remove: list[str]) -> int:
        """Adds a manifest; returns its number. What it removes must still be there."""
        for _ in range(ATTEMPTS):
            last, live = self.state()
            if gone := set(remove) - set(live):
                raise Conflict(f"{len(gone)} folders are gone already")
            manifest: dict = {"add": add, "remove": remove}
            if (last + 1) % SUMMED == 0:
                manifest["all"] = live
            if self._take(last + 1, manifest):
                return last + 1
        raise Conflict("other jobs write all the time")

    # -- contents

    def _shard(self) -> Column:
        return F.left("version", F.lit(self.digits))

    def _rows(self, folders: list[str] | None = None) -> DataFrame:
        live = self.state()[1] if folders is None else folders
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        base = f"{self.folder}/data"
        return self.spark.read.schema(SCHEMA).option("basePath", base).parquet(*[f"{base}/batch={x}" for x in live])

    def contents(self, folders: list[str] | None = None) -> DataFrame:
        """version, content, batch, shard: all contents that are stored, copies of one included."""
        return self._rows(folders).filter("path is null").drop("path", "part")

    def versions(self, directories: bool | None = None) -> DataFrame:
        """version of all that is stored, or of directories only, or of contents only."""
        rows = self._rows()
        return (rows if directories is None else rows.filter(F.col("path").isNotNull() == directories)).select("version").distinct()

    def _wanted(self, wanted: DataFrame, live: list[str]) -> DataFrame:
        few = wanted.select(F.col("version").alias("wanted"), self._shard().alias("beginning")).distinct()
        shards = [r[0] for r in few.select("beginning").distinct().collect()]  # at most 16 ** digits
        return self._rows(live).filter(F.col("shard").isin(shards)).join(few, (F.col("shard") == F.col("beginning")) & (F.col("version") == F.col("wanted")))

    def load(self, wanted: DataFrame) -> DataFrame:
        """version, content of the wanted versions (one column, version): files of other beginnings aren't read."""
        live = self.state()[1]
        if not live:
            return self.spark.createDataFrame([], "version string, content binary")
        return self._wanted(wanted, live).filter("path is null").select("version", "content").dropDuplicates(["version"])

    def trees(self, wanted: DataFrame) -> DataFrame:
        """version, path, part of the wanted directories (version): the versions of the files in them, null for inner directories and for the
        empty path, which each directory has. One that holds nothing is known without being stored."""
        live, columns = self.state()[1], ["version", "path", "part"]
        nothing = wanted.filter(F.col("version") == EMPTY).select("version", F.lit("").alias("path"), F.lit(None).cast("string").alias("part"))
        found = nothing if not live else self._wanted(wanted, live).filter("path is not null").select(columns).union(nothing)
        return found.dropDuplicates(["version", "path"])

    def save(self, rows: DataFrame, trees: DataFrame | None = None) -> int:
        """Stores the contents (version, content) that aren't there, each once, and the directories among trees (version, path, part,
        content: of all files in a directory, by its version) that aren't; returns how many contents and directories that were."""
        last, live = self.state()
        null = F.lit(None).cast("string")
        new = rows.select("version", F.col("content").cast("binary").alias("content"), null.alias("path"), null.alias("part"))
        if trees is not None:  # an entry is a row of its directory, and of a file the content besides
            entry = F.struct("version", F.lit(None).cast("binary").alias("content"), "path", "part")
            content = F.struct(F.col("part").alias("version"), F.col("content").cast("binary").alias("content"), null.alias("path"), null.alias("part"))
            new = new.union(trees.select(F.inline(F.array(entry, content))))
        new = new.filter("version is not null and (content is not null or path is not null)").dropDuplicates(["version", "path"])
        if live:
            held = self._rows(live).select(F.col("version").alias("held"), F.col("path").isNotNull().alias("tree")).distinct()
            new = new.join(held, (F.col("version") == F.col("held")) & (F.col("path").isNotNull() == F.col("tree")), "left_anti")
        name = f"save-{uuid.uuid4().hex}"
        # tasks of about equal size, each with few beginnings
        new.withColumn("shard", self._shard()).hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.folder}/data/batch={name}")
        n = self._rows([name]).filter("path is null or path = ''").count() if self._has_rows(name) else 0
        if n:
            self.commit([name], [])
        return n

    def _has_rows(self, name: str) -> bool:
        from pyarrow.fs import FileSelector

        system, base = filesystem(self.folder)
        return any(x.base_name.startswith("shard=") for x in system.get_file_info(FileSelector(f"{base}/data/batch={name}", allow_not_found=True)))

    def compact(self) -> int:
        """Puts all contents into one folder, each once; returns how many folders it took the place of. Saves may go on meanwhile."""
        _, live = self.state()
        if len(live) < 2:
            return 0
        name = f"compact-{uuid.uuid4().hex}"
        self._rows(live).drop("batch").dropDuplicates(["version", "path"]).hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.folder}/data/batch={name}")
        self.commit([name], live)
        return len(live)

    def vacuum(self) -> int:
        """Deletes data folders that no manifest names any more, and those of jobs that failed; call it while nothing is written."""
        from pyarrow.fs import FileSelector

        system, base = filesystem(self.folder)
        live = {f"batch={x}" for x in self.state()[1]}
        dead = [x.path for x in system.get_file_info(FileSelector(f"{base}/data", allow_not_found=True)) if x.base_name not in live]
        for path in dead:
            system.delete_dir(path)
        return len(dead)
