"""Artefacts as files: a data source that reads what matches a path pattern under a root, and writes elements back.

``spark.read.format("driftloom_files").option("root", ...).option("pattern", "raw/*/*.csv")`` has a column for each ``*``
(index_1, index_2, ...), relative, mtime, length and, unless the option content is false, content. A final ``/`` in the pattern asks for
directories. The folder of the first wildcard is listed when the query is planned and its folders are dealt to tasks (option tasks: how many), which
list what lies below them; equality and ``in`` on an index column are pushed to the listing, so that other folders aren't looked
at. A folder whose files are themselves the elements is listed by every task, which takes its share by name.

``write(df, root, pattern)`` writes rows (index_1, ..., content) as files; a null content deletes the element. Tasks write into a staging
folder and leave a list of what they made; the job counts when a record that names these lists stands in the root. Vanished elements
are then deleted and new ones moved to their places, one by one and by tasks, a list each; ``recover`` completes jobs that were cut off
while they did so. A job that fails leaves all elements as they were. Directories that go are moved to the job's folder in one step each;
what is in them is deleted by tasks while the caller goes on (``finish`` waits for them; ``recover`` deletes what a cut off process left).

An element of a pattern with a final ``/`` is a directory, whose rows have a path inside it too: a file's; an inner directory's, with a
final ``/``; or an empty one, which stands for the element itself. ``below`` lists them, ``write`` takes them: a null content deletes a
file, or a directory with all that is in it. A directory that isn't there yet is staged as a whole, by all tasks that have files of it, and
moved to its place in one step; if an attempt of a task failed, whose files could be there too, those of the others are moved one by one.

Defined cases: names that begin with a dot and side files are passed over; an index part of a file is its name up to the first dot; a
root or folder before the first wildcard that isn't there holds no elements; a literal part that is missing behind a wildcard, and two
files with one index, are errors, and so is an element that is written twice.
"""

from __future__ import annotations

import contextlib
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..functions.paths import HASH_SUFFIX, META_SUFFIX
from .roots import FOLDER, filesystem
from .tables import dealt

FORMAT = "driftloom_files"
#: folders of one task, at most so many tasks, if there are more; tasks that share one folder's files
TASKS, SHARES = 1024, 8
#: bytes of contents in one batch, about; steps of a list that are handed to a thread at a time
BATCH_BYTES, STEPS = 4 << 20, 64
#: files that a task stages in the job's folder; others go to a folder of the task's own, as tasks that make files in one folder wait for each other
BESIDE = 16
#: folders of a job's for directories that are staged as wholes, and for those that are deleted, in so many shards
WHOLE, GONE, SHARDS = "whole", "gone", 64


def ours(name: str) -> bool:
    return not name.startswith(".") and not name.lower().endswith((HASH_SUFFIX, META_SUFFIX))


def parts_of(pattern: str) -> tuple[list[str], bool]:
    """The pattern's parts, and whether it asks for directories; a wildcard of another form is an error."""
    directory = pattern.endswith("/")
    parts = pattern.rstrip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1 and not directory
        if "*" in part and not (part == "*" and not last or last and part.startswith("*.") and part.count("*") == 1):
            raise ValueError(f"a wildcard is * for a directory and *.suffix for files, not {part}")
    return parts, directory


@dataclass
class Found:
    index: tuple[str, ...]
    relative: str
    mtime_us: int
    length: int


@dataclass
class Walk:
    """Listing of what matches a pattern, as far as the wanted index parts allow."""

    root: str
    pattern: str
    wanted: dict[int, set[str]] = field(default_factory=dict)  # by position in the index, from 0

    def __post_init__(self) -> None:
        self.system, self.base = filesystem(self.root)
        self.parts, self.directory = parts_of(self.pattern)
        self.listed: list[str] = []

    def info(self, relative: str):
        return self.system.get_file_info(f"{self.base}/{relative}".rstrip("/"))

    def entries(self, folder: str, position: int, files: bool) -> list:
        """Files or folders in a folder ("" or with a final /), in order of name; only the wanted ones if they can be named."""
        from pyarrow.fs import FileSelector, FileType

        kind, names = FileType.File if files else FileType.Directory, self.wanted.get(position)
        if names is not None and not files:
            found = [self.info(folder + n) for n in sorted(names) if n and "/" not in n]
        else:
            self.listed.append(folder)
            found = self.system.get_file_info(FileSelector(f"{self.base}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted((x for x in found if x.type == kind and ours(x.base_name)), key=lambda x: x.base_name)

    def below(self, folder: str, index: tuple[str, ...], at: int, share: tuple[int, int] = (0, 1)) -> Iterator[Found]:
        """What matches from part number at on, in a folder that the parts before have led to."""
        from pyarrow.fs import FileType

        if at == len(self.parts):
            x = self.info(folder)
            yield Found(index, folder, (x.mtime_ns or 0) // 1000, 0)
            return
        part, last = self.parts[at], at == len(self.parts) - 1 and not self.directory
        if "*" not in part:
            if index and not ours(part):
                return
            x = self.info(folder + part)
            if x.type != (FileType.File if last else FileType.Directory):
                if index:
                    raise FileNotFoundError(f"{part} of {self.pattern} is missing under {'/'.join(index)}")
                return
            if last:
                yield Found(index, folder + part, (x.mtime_ns or 0) // 1000, x.size or 0)
            else:
                yield from self.below(f"{folder}{part}/", index, at + 1, share)
        elif not last:
            for x in self.entries(folder, len(index), files=False):
                yield from self.below(f"{folder}{x.base_name}/", (*index, x.base_name), at + 1, share)
        else:
            seen, names = set(), self.wanted.get(len(index))
            for x in self.entries(folder, len(index), files=True):
                stem, dot, _ = x.base_name.partition(".")
                if not stem or not x.base_name.endswith(part[1:]) or (names is not None and stem not in names) or zlib.crc32(stem.encode()) % share[1] != share[0]:
                    continue
                if stem in seen:
                    raise ValueError(f"several files of {self.pattern} have the index {'/'.join((*index, stem))}")
                seen.add(stem)
                yield Found((*index, stem), folder + x.base_name, (x.mtime_ns or 0) // 1000, x.size or 0)


@dataclass
class Part(InputPartition):
    folders: list[tuple[str, tuple[str, ...], int]]
    share: tuple[int, int] = (0, 1)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walk = {"root": options["root"], "pattern": options["pattern"]}
        self.content = options.get("content", "true").lower() != "false"
        self.tasks = int(options.get("tasks", TASKS))
        self.wanted: dict[int, set[str]] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else ""
            if column.startswith("index_") and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                position = int(column.removeprefix("index_")) - 1
                self.wanted[position] = self.wanted.get(position, values) & values
            yield f  # what is left is looked at again, row by row

    def partitions(self) -> Sequence[Part]:
        walk = Walk(**self.walk, wanted=self.wanted)
        first = next((i for i, p in enumerate(walk.parts) if "*" in p), None)
        if first is None:
            return [Part([("", (), 0)])]
        folder = "".join(f"{p}/" for p in walk.parts[:first])
        if first == len(walk.parts) - 1 and not walk.directory:
            shares = 1 if 0 in self.wanted else SHARES
            return [Part([(folder, (), first)], (i, shares)) for i in range(shares)]
        folders = [(f"{folder}{x.base_name}/", (x.base_name,), first + 1) for x in walk.entries(folder, 0, files=False)]
        each = max(1, -(-len(folders) // self.tasks))
        return [Part(folders[i : i + each]) for i in range(0, len(folders), each)]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        if partition is None:
            return
        walk = Walk(**self.walk, wanted=self.wanted)
        rank = walk.pattern.count("*")
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = {f"index_{i + 1}": pa.array([h[0].index[i] for h in held], pa.string()) for i in range(rank)}
            columns |= {"relative": pa.array([h[0].relative for h in held], pa.string()), "mtime": pa.array([h[0].mtime_us for h in held], pa.timestamp("us", tz="UTC")), "length": pa.array([h[0].length for h in held], pa.int64())}
            if self.content:
                columns["content"] = pa.array([h[1] for h in held], pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        for folder, index, at in partition.folders:
            for x in walk.below(folder, index, at, partition.share):
                content = None
                if self.content and not walk.directory:
                    with walk.system.open_input_stream(f"{walk.base}/{x.relative}") as source:
                        content = source.read()
                held.append((x, content))
                size += len(content or b"") + 200
                if size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


def place(pattern: str, index: Sequence[str]) -> str:
    """The pattern with its wildcards filled in; parts that would lead elsewhere are an error."""
    out, rest = "", pattern
    for part in index:
        if not part or "/" in part or part.startswith(".") or "\\" in part:
            raise ValueError(f"{part!r} is no part of an index")
        before, _, rest = rest.partition("*")
        out += before + part
    return out + rest


def inner(path: str) -> str:
    """A path inside a directory that is an element; one that would lead elsewhere, or that no listing would show, is an error."""
    if path and ("\\" in path or not all(part and ours(part) for part in path.removesuffix("/").split("/"))):
        raise ValueError(f"{path!r} is no path inside an element")
    return path


@dataclass
class Made(WriterCommitMessage):
    listing: str
    gone: bool  # whether the list has deletions
    made: bool  # whether it has other steps
    whole: bool = False  # whether there are lists of directories that are staged as a whole, and of what the task put into them


class Writer(DataSourceArrowWriter):
    """Elements are staged by tasks and put in place at the commit."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.pattern = options["root"], options["pattern"]
        self.later = "job" in options  # whoever named the job puts its elements in place
        self.job = options.get("job", uuid.uuid4().hex)
        self.index = [f"index_{i + 1}" for i in range(self.pattern.count("*"))]
        self.inside = ["path"] if self.pattern.endswith("/") else []
        if missing := {*self.index, *self.inside, "content"} - set(columns):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")

    def staging(self) -> str:
        return f"{FOLDER}/staging/{self.job}"

    def write(self, iterator: Iterator) -> Made:
        import pyarrow as pa
        from pyarrow.fs import FileType

        system, base = filesystem(self.root)
        folder, task = f"{base}/{self.staging()}", uuid.uuid4().hex
        system.create_dir(folder, recursive=True)
        n, seen, gone, inside = 0, set(), 0, 0
        new: dict[str, bool] = {}  # directories that are elements: whether they aren't there yet
        folders: set[str] = set()
        with system.open_output_stream(f"{folder}/{task}.list") as listing, contextlib.ExitStack() as more:
            for batch in iterator:
                contents = batch.column("content").cast(pa.binary())
                for i, index in enumerate(zip(*(batch.column(c).to_pylist() for c in (*self.index, *self.inside)), strict=True) if self.index or self.inside else [()] * len(contents)):
                    index, content = [*index], contents[i].as_py()  # one content at a time
                    path = inner(index.pop()) if self.inside else ""
                    relative = place(self.pattern, index) + path
                    if relative in seen:
                        raise ValueError(f"{relative} is written twice")
                    seen.add(relative)
                    if self.inside and content is not None:
                        element = relative.removesuffix(path)
                        if element not in new:
                            new[element] = system.get_file_info(f"{base}/{element}".rstrip("/")).type == FileType.NotFound
                            if new[element]:
                                if not inside:
                                    wholes, parts = (more.enter_context(system.open_output_stream(f"{folder}/{task}.{x}")) for x in ("wholes", "parts"))
                                wholes.write(json.dumps([element, f"{WHOLE}/{element}"]).encode() + b"\n")
                        if new[element]:
                            above = relative.rpartition("/")[0]
                            if above not in folders:
                                system.create_dir(f"{folder}/{WHOLE}/{above}", recursive=True)
                                folders.add(above)
                            if not relative.endswith("/"):
                                with system.open_output_stream(f"{folder}/{WHOLE}/{relative}") as out:
                                    out.write(content)
                            parts.write(json.dumps([relative, "" if relative.endswith("/") else f"{WHOLE}/{relative}"]).encode() + b"\n")
                            inside += 1
                            continue
                    staged = None
                    if content is not None and relative.endswith("/"):
                        staged = ""
                    elif content is not None:
                        if n == BESIDE:
                            system.create_dir(f"{folder}/{task}")
                        staged = f"{task}-{n}" if n < BESIDE else f"{task}/{n}"
                        with system.open_output_stream(f"{folder}/{staged}") as out:
                            out.write(content)
                        n += 1
                    gone += staged is None
                    listing.write(json.dumps([relative, staged]).encode() + b"\n")
        return Made(f"{task}.list", gone > 0, len(seen) > gone + inside, inside > 0)

    def commit(self, messages: list[Made | None]) -> None:
        from pyarrow.fs import FileSelector

        system, base = filesystem(self.root)
        system.create_dir(f"{base}/{FOLDER}/commits", recursive=True)
        record = f"{base}/{FOLDER}/commits/{self.job}"
        lists = {side: [m.listing for m in messages if m is not None and getattr(m, side)] for side in ("gone", "made")}
        if wholes := [m.listing.removesuffix("list") for m in messages if m is not None and m.whole]:
            begun = sum(x.base_name.endswith(".list") for x in system.get_file_info(FileSelector(f"{base}/{self.staging()}")))
            lists["made"] += [name + ("wholes" if begun == sum(m is not None for m in messages) else "parts") for name in wholes]
        with system.open_output_stream(f"{record}.new") as out:
            out.write(json.dumps(lists).encode())
        system.move(f"{record}.new", f"{record}.json")  # from here on the job counts
        if not self.later:
            put_in_place(self.root, self.job)

    def abort(self, messages: list[Made | None]) -> None:
        system, base = filesystem(self.root)
        system.delete_dir_contents(f"{base}/{self.staging()}", missing_dir_ok=True)


def _carry_out(root: str, job: str, listing: str, deleting: bool) -> None:
    """The deletions of a task's list, or its other steps; doing them again does no harm."""
    from itertools import islice

    from pyarrow.fs import FileSelector, FileType

    system, base = filesystem(root)
    folder = f"{base}/{FOLDER}/staging/{job}"
    made: set[str] = set()  # folders that are there

    def kind(path: str) -> FileType:
        return system.get_file_info(path.rstrip("/")).type

    def move(staged: str, to: str) -> None:
        try:
            system.move(staged, to)
        except FileNotFoundError:
            if kind(to) != FileType.File:
                raise

    def whole(staged: str, to: str) -> None:
        """Moves a directory; into one that is there by now, what is in it."""
        if kind(staged) != FileType.Directory:  # it was moved before
            return
        system.create_dir(to.rpartition("/")[0], recursive=True)
        if kind(to) == FileType.NotFound:
            try:
                return system.move(staged, to)
            except OSError:  # another attempt did it, or made the directory
                if kind(to) != FileType.Directory:
                    raise
        for x in system.get_file_info(FileSelector(staged, allow_not_found=True)):
            if x.type == FileType.Directory:
                whole(x.path, f"{to}/{x.base_name}")
            else:
                move(x.path, f"{to}/{x.base_name}")

    def one(line: bytes) -> None:
        relative, staged = json.loads(line)
        to = f"{base}/{relative}"
        if staged is None and deleting:
            try:
                if relative.endswith("/") and kind(to) == FileType.Directory:
                    aside = f"{folder}/{GONE}/{zlib.crc32(relative.encode()) % SHARDS}"
                    system.create_dir(aside, recursive=True)
                    system.move(to.rstrip("/"), f"{aside}/{uuid.uuid4().hex}")
                elif not relative.endswith("/") and kind(to) == FileType.File:
                    system.delete_file(to)
            except FileNotFoundError:  # another attempt, or the deletion of the directory above
                pass
        elif staged == "" and not deleting:
            system.create_dir(to.rstrip("/"), recursive=True)
        elif staged and staged.endswith("/") and not deleting:
            whole(f"{folder}/{staged}".rstrip("/"), to.rstrip("/"))
        elif staged and not deleting and kind(f"{folder}/{staged}") != FileType.NotFound:  # else it was moved before
            if (above := to.rpartition("/")[0]) not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            move(f"{folder}/{staged}", to)

    def each(part: list[bytes]) -> None:
        for line in part:
            one(line)

    with system.open_input_stream(f"{folder}/{listing}") as source, ThreadPoolExecutor(16) as pool:
        lines = iter(source.read().splitlines())
        parts = iter(lambda: [*islice(lines, STEPS)], [])
        while some := [*islice(parts, 64)]:
            list(pool.map(each, some))


def put_in_place(root: str, job: str, spark: SparkSession | None = None) -> None:
    """Deletes what a job says is gone, and then moves its elements to their places: in tasks, if a session is given."""
    import pyarrow as pa
    from pyarrow.fs import FileType

    system, base = filesystem(root)
    record = f"{base}/{FOLDER}/commits/{job}.json"
    with system.open_input_stream(record) as source:
        found = json.loads(source.read())  # lists, as many as tasks wrote
    for side in ("gone", "made"):
        listings, deleting = found[side] if isinstance(found, dict) else found, side == "gone"  # a list alone: by those who didn't tell them apart
        if spark is None or not listings:
            for listing in listings:
                _carry_out(root, job, listing, deleting)
            continue

        def work(batches: Iterator[pa.RecordBatch], deleting: bool = deleting) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for listing in batch.column(0).to_pylist():
                    _carry_out(root, job, listing, deleting)
                yield batch

        rows = spark.createDataFrame([(x,) for x in listings], "listing string").repartition(len(listings))
        rows.mapInArrow(work, "listing string").write.format("noop").mode("overwrite").save()
    system.delete_file(record)
    if spark is not None and system.get_file_info(f"{base}/{FOLDER}/staging/{job}/{GONE}").type == FileType.Directory:
        _sweeps.setdefault(root, []).append(_sweepers.submit(_sweep, spark, root, job))
    else:
        system.delete_dir(f"{base}/{FOLDER}/staging/{job}")


#: deletions that go on, by root
_sweeps: dict[str, list[Future]] = {}
_sweepers = ThreadPoolExecutor(1)


def _sweep(spark: SparkSession, root: str, job: str) -> None:
    """Deletes the directories that a job has put aside, in few tasks: their threads wait for the filesystem, not for a core."""
    import pyarrow as pa

    at = f"{FOLDER}/staging/{job}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                _delete_below(root, f"{at}/{GONE}/{shard}")
            yield batch

    tasks = max(1, spark.sparkContext.defaultParallelism // 6)
    rows = spark.range(SHARDS).select(F.col("id").cast("string").alias("shard")).repartition(tasks)
    rows.mapInArrow(work, "shard string").write.format("noop").mode("overwrite").save()
    system, base = filesystem(root)
    system.delete_dir(f"{base}/{at}")


def _delete_below(root: str, folder: str) -> None:
    """Deletes all files below a folder, many at a time."""
    from itertools import batched

    from pyarrow.fs import FileSelector, FileType

    system, base = filesystem(root)

    def delete(paths: Sequence[str]) -> None:
        for path in paths:
            system.delete_file(path)

    with ThreadPoolExecutor(32) as pool:
        above = [f"{base}/{folder}"]
        while above:
            found = system.get_file_info(FileSelector(above.pop(), allow_not_found=True))
            above += [x.path for x in found if x.type == FileType.Directory]
            list(pool.map(delete, batched((x.path for x in found if x.type != FileType.Directory), STEPS)))


def finish(root: str) -> None:
    """Waits until the directories that jobs of this process have put aside are deleted; an error of a deletion is raised here."""
    while waiting := _sweeps.get(root):
        waiting.pop(0).result()
    _sweeps.pop(root, None)


def recover(root: str, clean: bool = True, spark: SparkSession | None = None) -> int:
    """Completes the jobs that count but were cut off while they moved elements (in tasks, if a session is given); returns how many there
    were. Call it while no job puts elements in place; with clean, what other jobs have staged is deleted, so none may be running at all."""
    from pyarrow.fs import FileSelector, FileType

    system, base = filesystem(root)
    records = system.get_file_info(FileSelector(f"{base}/{FOLDER}/commits", allow_not_found=True))
    jobs = [x.base_name.removesuffix(".json") for x in records if x.base_name.endswith(".json")]
    for job in jobs:
        put_in_place(root, job, spark)
    for x in system.get_file_info(FileSelector(f"{base}/{FOLDER}/staging", allow_not_found=True)):
        if clean and x.type == FileType.Directory:
            system.delete_dir(x.path)
    return len(jobs)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        parts_of(self.options["pattern"])
        index = "".join(f"index_{i + 1} string, " for i in range(self.options["pattern"].count("*")))
        return f"{index}relative string, mtime timestamp, length bigint" + (", content binary" if self.options.get("content", "true").lower() != "false" else "")

    def reader(self, schema: Any) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("elements are put in place or deleted one by one: use mode append")
        return Writer(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)


def read(spark: SparkSession, root: str, pattern: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(root=root, pattern=pattern, content=str(content).lower(), tasks=4 * spark.sparkContext.defaultParallelism).load()


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """index, relative, mtime, length of the elements in place."""
    index = F.array(*[F.col(f"index_{i + 1}") for i in range(pattern.count("*"))]).cast("array<string>")
    return read(spark, root, pattern, content=False).select(index.alias("index"), "relative", "mtime", "length")


def contents(root: str, listed: DataFrame) -> DataFrame:
    """index, content of listed elements (index of any type, relative): only their files are read, where Spark deals them to. A directory has none, and
    neither has a file that went meanwhile."""
    import pyarrow as pa

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for batch in batches:
            at, held, size = 0, [], 0
            for i, relative in enumerate(batch.column("relative").to_pylist()):
                content = None
                if relative and not relative.endswith("/"):
                    try:
                        with system.open_input_stream(f"{base}/{relative}") as source:
                            content = source.read()
                    except FileNotFoundError:
                        pass
                held.append(content)
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column("index").slice(at, len(held)), pa.array(held, pa.binary())], ["index", "content"])
                    at, held, size = i + 1, [], 0
            if held:
                yield pa.RecordBatch.from_arrays([batch.column("index").slice(at, len(held)), pa.array(held, pa.binary())], ["index", "content"])

    return dealt(listed.select("index", "relative"), "relative").mapInArrow(fetch, f"index {listed.schema['index'].dataType.simpleString()}, content binary")


def below(spark: SparkSession, root: str, pattern: str, listed: DataFrame) -> DataFrame:
    """index, path, relative, mtime of all that is inside directories (index), the directories themselves with an empty path; those that
    aren't there are passed over. Folders are listed in tasks, a level in each round."""
    from ..functions.paths import apply_index
    from .patterns import entries

    parts = parts_of(pattern)[0]
    found = entries(spark, root, listed.select(apply_index(F.lit(pattern), F.col("index")).alias("relative")))
    names = F.split("relative", "/")
    index = F.array(*[names[i] for i, part in enumerate(parts) if part == "*"]).cast("array<string>").alias("index")
    path = F.array_join(F.slice(names, len(parts) + 1, F.size(names)), "/").alias("path")
    return found.select(index, path, "relative", "mtime")


def write(rows: DataFrame, root: str, pattern: str) -> None:
    """Puts elements (index, content; or index_1, ..., content; of directories with path) in place; those with null content are deleted."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    register(spark)
    names = [f"index_{i + 1}" for i in range(pattern.count("*"))]
    inside = ["path"] if pattern.endswith("/") else []
    if "index" in rows.columns:
        rows = rows.select(*[F.col("index")[i].alias(n) for i, n in enumerate(names)], *inside, "content")
    rows = rows.select(*names, *inside, F.col("content").cast("binary").alias("content"))
    rows = dealt(rows, *names, *inside) if names or inside else rows.coalesce(1)  # an element that comes twice comes to one task
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))  # a task's Python holds one batch; whole texts make ten thousand rows a large one
    try:
        rows.write.format(FORMAT).options(root=root, pattern=pattern, job=job).mode("append").save()
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)
    put_in_place(root, job, spark)
