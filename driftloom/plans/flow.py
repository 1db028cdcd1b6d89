"""Incremental recomputation of methods over indexed collections.

An artefact is a DataFrame (index array<string>, content string or binary). A method maps its inputs to its outputs, instance by
instance: an instance is an index of length min(rank of inputs, rank of outputs). ``status`` compares present versions
with those that the method last saw; ``compute`` runs methods on stale instances only, takes what is missing but
stored from the store, drops outputs of vanished inputs, and records what was seen. Methods are ordered by level on
the driver (one entry a method); elements stay in DataFrames.

A flow with a root takes its artefacts from files (``scan``) and puts what it makes in place as files: those of the instances that ran, and
no others, in one job for each output. What methods saw is then kept in the root too, in buckets of which a run rewrites those of
the instances that it touched; ``Flow.open`` goes on from there in another session. Contents are saved to the stores that the
configuration names, each a log of manifests in its own folder.

An artefact whose pattern ends with ``/`` is a vector of directories, for flows with a root only: (index, path, content), a row for each file
inside, and rows with a null content for directories: inner ones (``sub/``) and the element itself (an empty path), which an empty
directory needs. Its version is the digest of its tree; an instance that runs again replaces its directory, of which other files go.
Hidden and side files play no part and can't be made.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fingerprints import directory_versions, version
from ..operators.staleness import ALL_EXIST, INPUTS, OUTPUTS, UP_TO_DATE, group_decision, presence, propagate_elements
from ..sources import files, metadata, patterns
from ..sources.contents import ContentStore
from ..sources.expectations import BUCKETS, Expectations
from ..sources.roots import FOLDER, Config, filesystem, open_root
from ..sources.tables import new_folder, settle

#: (instance array<string>, and of each input the columns index_k, content_k) -> (index array<string>, content)
Function = Callable[..., DataFrame]
DIRECTORY = "directory"
EXPECTED = "method string, role string, port int, instance array<string>, index array<string>, expected string"


@dataclass(frozen=True)
class Method:
    """A function of DataFrames. Its signature covers its text, inputs and outputs, so that a change of any voids what was recorded."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    function: Function
    #: what the function does; changes with it, as functions can't be compared
    text: str

    @property
    def name(self) -> str:
        return min(self.outputs)

    @property
    def signature(self) -> str:
        return "\n".join([self.text, *self.inputs, "->", *self.outputs])

    @property
    def rank(self) -> int:
        ins = max((a.count("*") for a in self.inputs), default=0)
        return min(ins, max(a.count("*") for a in self.outputs))


class Artefacts(dict):
    """DataFrames by artefact; one whose files are still to be listed is a function, which is called when somebody asks for it."""

    def __getitem__(self, artefact: str) -> DataFrame:
        rows = super().__getitem__(artefact)
        if not isinstance(rows, DataFrame):
            self[artefact] = rows = rows()
        return rows

    def get(self, artefact: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[artefact] if artefact in self else default

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(artefact, self[artefact]) for artefact in self]


@dataclass
class Flow:
    spark: SparkSession
    artefacts: dict[str, DataFrame] = field(default_factory=Artefacts)
    methods: dict[str, Method] = field(default_factory=dict)
    root: str | None = None  # of a flow whose artefacts are files
    config: Config = field(default_factory=Config)
    buckets: int = BUCKETS  # of recorded versions, if the root has none yet
    tracked: set[str] = field(default_factory=set)  # artefacts that have ever been saved
    seen: dict[str, DataFrame] = field(default_factory=dict)  # EXPECTED by method
    signed: dict[str, str] = field(default_factory=dict)
    sources: dict[str, DataFrame] = field(default_factory=dict)  # recorded versions of sources: index, expected
    kinds: dict[str, str] = field(default_factory=dict)  # type of an artefact's contents: string, unless it is known to be binary
    listed: dict[str, DataFrame] = field(default_factory=dict)  # with a root: index, relative, actual of the elements in place
    _home: str | None = None  # what relative stores lie under, without a root
    _versions: dict[str, tuple[int, DataFrame]] = field(default_factory=dict)  # what stores held at a manifest
    _written: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)  # parts of the state as they were written

    # -- definition

    def source(self, artefact: str, rows: DataFrame) -> None:
        """Puts a source's present elements in place."""
        self._place(artefact, settle(rows.select("index", "content")))

    def _place(self, artefact: str, rows: DataFrame) -> None:
        self.artefacts[artefact] = rows
        self.listed.pop(artefact, None)
        self.kinds[artefact] = rows.schema["content"].dataType.simpleString()

    def scan(self, artefact: str, text: bool = False) -> None:
        """Takes an artefact's elements from the files under the root; as text in UTF-8 if asked for. Files that are as they were when they
        were last hashed aren't read; contents are read when a method needs them."""
        if self.root is None:
            raise ValueError("the flow has no root")
        self._scan({artefact: text})

    def _scan(self, texts: dict[str, bool]) -> None:
        listed = {a: settle(files.listing(self.spark, self.root, a)) for a in texts}
        versions = settle(patterns.cached_versions(self.spark, self.root, listed)) if listed else None
        for a, text in texts.items():
            self.listed[a] = settle(listed[a].join(versions.withColumnRenamed("version", "actual"), "relative").select("index", "relative", "actual"))
            self.kinds[a] = DIRECTORY if a.endswith("/") else "string" if text else "binary"
            self.artefacts[a] = self._reading(a)

    def _reading(self, artefact: str) -> Callable[[], DataFrame]:
        listed = self.listed[artefact]
        return lambda: self._read(artefact, listed)

    def _put(self, artefact: str, kept: DataFrame | None, new: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Writes new elements (index, content) as files beside those kept (index, relative, actual), and deletes others (index). What was
        written is known by its contents, so that files aren't read back."""
        def known(rows: DataFrame) -> DataFrame:
            if "content" not in rows.columns:
                return rows.select("index", "relative", "actual")
            if artefact.endswith("/"):
                part = F.when((F.col("path") != "") & ~F.col("path").endswith("/"), version(F.col("content").cast("binary")))
                rows = directory_versions(rows.select("index", "path", part.alias("version")))
                return rows.select("index", paths.apply_index(F.lit(artefact), F.col("index")).alias("relative"), F.col("version").alias("actual"))
            return rows.select("index", paths.apply_index(F.lit(artefact), F.col("index")).alias("relative"), version(F.col("content").cast("binary")).alias("actual"))

        self._publish(artefact, new, gone)
        rows = None if kept is None else known(kept)
        if new is not None:
            rows = known(new) if rows is None else rows.union(known(new))
            self.kinds[artefact] = DIRECTORY if artefact.endswith("/") else new.schema["content"].dataType.simpleString()
        self.listed[artefact] = settle(rows)
        self.artefacts[artefact] = self._reading(artefact)

    def _read(self, artefact: str, rows: DataFrame) -> DataFrame:
        """index, content of listed elements; of directories index, path, content."""
        if artefact.endswith("/"):
            found = files.below(self.spark, self.root, artefact, rows)
            read = files.contents(self.root, found.select(F.struct("index", "path").alias("index"), "relative"))
            return read.select("index.index", "index.path", "content")
        out = files.contents(self.root, rows)
        return out.select("index", F.decode("content", "UTF-8").alias("content")) if self.kinds[artefact] == "string" else out

    def _of(self, artefact: str, stale: DataFrame, m: Method) -> DataFrame:
        """The artefact's elements that stale instances of a method use; of files, no others are read."""
        k = min(m.rank, artefact.count("*"))
        keys = stale.select(F.slice("instance", 1, k).alias("key")).distinct()
        some = lambda rows: rows.join(keys, F.slice("index", 1, k) == F.col("key"), "left_semi")
        return self._read(artefact, some(self.listed[artefact])) if artefact in self.listed else some(self.artefacts[artefact])

    def _publish(self, artefact: str, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Puts elements in place as files and deletes others (index), if the flow has a root."""
        if self.root is None:
            return
        if artefact.endswith("/"):
            return self._publish_directories(artefact, rows, gone)
        out = None if rows is None else rows.select("index", F.col("content").cast("binary").alias("content"))
        if gone is not None:
            none = gone.select("index", F.lit(None).cast("binary").alias("content"))
            out = none if out is None else out.union(none)
        if out is not None:
            files.write(out, self.root, artefact)

    def _publish_directories(self, artefact: str, rows: DataFrame | None, gone: DataFrame | None) -> None:
        """Puts directories in the place of those that are there; of these, what the new ones don't have goes."""
        nothing, out = F.lit(None).cast("binary").alias("content"), None
        if rows is not None:
            made = F.when((F.col("path") == "") | F.col("path").endswith("/"), F.lit(b"")).otherwise(F.coalesce(F.col("content").cast("binary"), F.lit(b"")))
            out = rows.select("index", "path", made.alias("content"))
            was = files.below(self.spark, self.root, artefact, rows.select("index").distinct()).filter("path <> ''")
            if not was.isEmpty():
                is_folder = F.col("path").endswith("/")
                folders = was.filter(is_folder).select("index", "path")
                kept = rows.filter(is_folder).select("index", "path").union(rows.select("index", F.explode(_above(F.col("path")))))
                # a file that holds the same content, as far as it is known by the cache, stays
                known = F.when(F.col("cache_mtime") > F.col("mtime"), F.col("cached")).alias("known")
                there = was.filter(~is_folder).join(patterns.read_cache(self.spark, self.root), "relative", "left").select("index", "path", known, F.lit(True).alias("there"))
                both = out.withColumn("actual", version(F.col("content"))).join(there, ["index", "path"], "full_outer")
                out = both.filter("there is null or content is null or not actual <=> known").select("index", "path", "content")
                if not folders.isEmpty():
                    out = out.union(folders.join(kept, ["index", "path"], "left_anti").select("index", "path", nothing))
        if gone is not None:
            gone = gone.select("index", F.lit("").alias("path"), nothing)
            out = gone if out is None else out.union(gone)
        if out is not None:
            files.write(out, self.root, artefact)

    def build(self, inputs: list[str], outputs: list[str], function: Function, text: str) -> Method:
        """Registers a method, in the place of an older one with the same outputs."""
        if self.root is None and any(a.endswith("/") for a in (*inputs, *outputs)):
            raise ValueError("directories are artefacts of flows with a root only")
        if clash := {o for o in outputs for m in self.methods.values() if o in m.outputs and m.name != min(outputs)}:
            raise ValueError(f"another method makes {', '.join(sorted(clash))}")
        method = Method(tuple(inputs), tuple(outputs), function, text)
        self.methods[method.name] = method
        self.ordered([*outputs])  # a cycle is an error
        return method

    def producer(self, artefact: str) -> Method | None:
        return next((m for m in self.methods.values() if artefact in m.outputs), None)

    def ordered(self, targets: list[str]) -> list[Method]:
        """Methods that the targets depend on, producers first."""
        out: list[Method] = []
        open_: set[str] = set()

        def visit(artefact: str) -> None:
            m = self.producer(artefact)
            if m is None or m in out:
                return
            if m.name in open_:
                raise ValueError(f"{m.name} depends on itself")
            open_.add(m.name)
            for i in m.inputs:
                visit(i)
            out.append(m)

        for t in targets:
            visit(t)
        return out

    # -- versions

    def items(self, artefact: str) -> DataFrame:
        """index, actual of the elements in place."""
        if artefact in self.listed:
            return self.listed[artefact].select("index", "actual")
        rows = self.artefacts.get(artefact)
        if rows is None:
            return self.spark.createDataFrame([], "index array<string>, actual string")
        return rows.select("index", version(F.col("content").cast("binary")).alias("actual"))

    def _expected(self, m: Method) -> DataFrame:
        rows = self.seen.get(m.name)
        if rows is None:
            return self.spark.createDataFrame([], EXPECTED)
        valid = self.signed.get(m.name) == m.signature
        return rows if valid else rows.withColumn("expected", F.when(F.col("role") == "in", F.col("expected")))

    def _instances(self, m: Method) -> DataFrame:
        """Indices of the method's instances, from its inputs of the highest rank present now or seen before."""
        if not m.inputs or m.rank == 0:
            return self.spark.createDataFrame([([],)], "instance array<string>")
        out = None
        for a in m.inputs:
            if a.count("*") >= m.rank:
                present = self.items(a).select(F.slice("index", 1, m.rank).alias("instance")).distinct()
                recorded = self._expected(m).filter("role = 'in'").join(self._held(), "expected").filter(F.size("index") == a.count("*")).select("instance") if a not in self.artefacts or self.items(a).isEmpty() else None
                present = present if recorded is None else present.union(recorded).distinct()
                out = present if out is None else out.join(present, "instance", "left_semi")
        return out

    def store(self, name: str | None = None) -> ContentStore:
        """The store of some name, or the default one; an unknown name is an error."""
        if self._home is None:
            self._home = self.root or new_folder(self.spark, "flow")
        return ContentStore(self.spark, self.config.folder(self._home, name))

    def _held(self) -> DataFrame:
        """expected: all versions that any store holds."""
        out = self.spark.createDataFrame([], "expected string")
        for name in sorted(self.config.stores):
            store = self.store(name)
            last, live = store.state()
            if live:
                if self._versions.get(name, (-1, None))[0] != last:
                    self._versions[name] = (last, settle(store.versions().select(F.col("version").alias("expected"))))
                out = out.union(self._versions[name][1])
        return out.distinct()

    def _elements(self, m: Method) -> DataFrame:
        """instance, role, expected, actual, in_store: every element that an instance saw or would see."""
        ports = [(role, port, a, min(m.rank, a.count("*"))) for role, side in (("in", m.inputs), ("out", m.outputs)) for port, a in enumerate(side, 1)]
        each = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(port).alias("port"), F.lit(k).alias("shared")) for role, port, _, k in ports])
        slots = self._instances(m).select("instance", F.inline(each)).withColumn("key", F.slice("instance", F.lit(1), F.col("shared")))
        now = None
        for role, port, a, k in ports:
            part = self.items(a).select(F.lit(role).alias("role"), F.lit(port).alias("port"), "index", "actual", F.slice("index", 1, k).alias("key"))
            now = part if now is None else now.union(part)
        place = ["role", "port", "instance"]
        here = slots.join(now, ["role", "port", "key"]).select(*place, "index", "actual")  # what is in place belongs to all instances that begin with its index
        saw = self._expected(m).select(*place, "index", "expected")
        both = saw.join(here, [*place, "index"], "full_outer").select(*place, "expected", "actual")
        null = F.lit(None).cast("string")
        none = slots.join(both.select(*place).distinct(), place, "left_anti").select(*place, null.alias("expected"), null.alias("actual"))
        return presence(both.union(none), self._held().withColumnRenamed("expected", "version"), "expected")

    def decisions(self, m: Method) -> DataFrame:
        """instance, state of a method's instances by themselves."""
        grouped = group_decision(self._elements(m), ["instance", "role"]).groupBy("instance").pivot("role", ["in", "out"]).agg(F.first("decision"))
        good = lambda c: F.coalesce(F.col(c), F.lit(ALL_EXIST)) == ALL_EXIST
        state = F.when(~good("in"), INPUTS).when(~good("out"), OUTPUTS).otherwise(UP_TO_DATE)
        return self._instances(m).join(grouped, "instance", "left").select("instance", state.alias("state"))

    def status(self, target: str) -> dict[str, DataFrame]:
        """index-wise state (instance, state) of each method that the target depends on; what is below stale inputs has outdated inputs.
        The methods are joined into one table, through which outdated instances propagate."""
        methods = self.ordered([target])
        own = self.spark.createDataFrame([], "method string, instance array<string>, status string")
        for m in methods:
            own = own.union(self.decisions(m).select(F.lit(m.name), "instance", "state"))
        edges = [(above.name, m.name, min(m.rank, above.rank)) for m in methods for a in m.inputs if (above := self.producer(a)) is not None]
        rows = settle(propagate_elements(own, self.spark.createDataFrame(sorted(set(edges)), "producer string, consumer string, shared int")))
        return {m.name: rows.filter(F.col("method") == m.name).select("instance", F.col("status").alias("state")) for m in methods}

    # -- action

    def _fetch(self, artefact: str, wanted: DataFrame) -> None:
        """Takes elements (index, expected) that aren't in place from the stores, the last by name that holds them."""
        stores = [store for name in sorted(self.config.stores, reverse=True) if (store := self.store(name)).state()[0] >= 0]
        if not stores:
            return
        missing = wanted.filter("expected is not null").select("index", "expected").distinct()
        if artefact in self.artefacts:
            missing = missing.join(self.items(artefact).select("index"), "index", "left_anti")
        missing, kind = settle(missing), self.kinds.get(artefact, "string")
        for store in stores:
            if missing.isEmpty():
                return
            versions = missing.select(F.col("expected").alias("version"))
            if artefact.endswith("/"):
                inside = settle(missing.join(store.trees(versions).withColumnRenamed("version", "expected"), "expected").select("index", "path", "part"))
                held = store.load(inside.filter("part is not null").select(F.col("part").alias("version"))).withColumnRenamed("version", "part")
                found = settle(inside.join(held, "part", "left").select("index", "path", "content"))
            else:
                held = store.load(versions).withColumnRenamed("version", "expected")
                found = settle(missing.join(held, "expected").select("index", F.col("content").cast(kind).alias("content")))
            missing = settle(missing.join(found.select("index"), "index", "left_anti"))
            if found.isEmpty():
                continue
            if self.root is not None:
                self._put(artefact, self.listed.get(artefact), found)
            else:
                have = self.artefacts.get(artefact)
                self._place(artefact, settle(found if have is None else have.union(found)))

    def compute(self, target: str) -> dict[str, int]:
        """Brings a target up to date; returns how many instances of each method ran."""
        ran: dict[str, int] = {}
        for a in {i for m in self.ordered([target]) for i in m.inputs if self.producer(i) is None}:
            if a in self.sources and (a not in self.artefacts or self.root is not None and self.items(a).isEmpty()):
                self._fetch(a, self.sources[a])  # nothing of it is in place: all that was recorded is wanted
            self._record_source(a)
        for m in self.ordered([target]):
            stale = settle(self.decisions(m).filter(F.col("state") != UP_TO_DATE).select("instance"))
            ran[m.name] = stale.count()
            if ran[m.name]:
                for port, a in enumerate(m.inputs, 1):
                    whole = "*" in a and a.count("*") > m.rank and a in self.artefacts
                    if not whole:  # of a vector to be reduced, what went is not fetched again
                        seen = self._expected(m).filter((F.col("role") == "in") & (F.col("port") == port)).join(stale, "instance", "left_semi")
                        self._fetch(a, seen)
                        self._fetch(a, self._recorded(a).join(seen.select("index"), "index", "left_anti"))  # never seen by this method
            self._run(m, stale if ran[m.name] else None)
        if self.root is not None:  # until then what was recorded of new methods doesn't count
            self._keep_methods()
        last = self.producer(target)
        if last is not None:
            port = last.outputs.index(target) + 1
            self._fetch(target, self._expected(last).filter((F.col("role") == "out") & (F.col("port") == port)))
        return ran

    def _record_source(self, artefact: str) -> None:
        """What a source holds now is what it was last seen with."""
        old, now = self.sources.get(artefact), settle(self.items(artefact).select("index", F.col("actual").alias("expected")))
        self.sources[artefact] = now
        if self.root is not None:
            was = self.spark.createDataFrame([], "index array<string>, expected string") if old is None else old
            both = now.join(was.withColumnRenamed("expected", "was"), "index", "full_outer").filter("not expected <=> was")
            touched = both.select(F.lit(artefact).alias("method"), F.col("index").alias("instance"))
            rows = now.select(F.lit(artefact).alias("method"), F.lit("source").alias("role"), F.lit(1).alias("port"), F.col("index").alias("instance"), "index", "expected")
            self._expectations().replace(touched, rows)

    def _expectations(self) -> Expectations:
        return Expectations(self.spark, f"{self.root.rstrip('/')}/{FOLDER}/expected", self.buckets)

    def _run(self, m: Method, stale: DataFrame | None) -> None:
        instances = settle(self._instances(m))
        made: dict[str, DataFrame] = {}
        if stale is not None:
            frames = [self._of(a, stale, m) for a in m.inputs]
            got = m.function(*frames) if m.inputs else m.function(self.spark)
            got = got if isinstance(got, tuple) else (got,)
            if len(got) != len(m.outputs):
                raise ValueError(f"{m.name}: {len(m.outputs)} outputs are declared, {len(got)} were made")
            made = {o: settle(rows.select("index", *["path"] * o.endswith("/"), "content")) for o, rows in zip(m.outputs, got, strict=True)}
        for o in m.outputs:
            k, new = min(m.rank, o.count("*")), made.get(o)
            before = old = self.listed[o] if o in self.listed else self.artefacts.get(o)
            if old is not None:
                key = F.slice("index", 1, k)
                old = old.join(instances.select(F.slice("instance", 1, k).alias("key")).distinct(), key == F.col("key"), "left_semi")
                if stale is not None:
                    old = old.join(stale.select(F.slice("instance", 1, k).alias("key")).distinct(), key == F.col("key"), "left_anti")
            if self.root is not None:
                here = [rows.select("index") for rows in (old, new) if rows is not None]
                gone = None if before is None else settle(before.select("index").join(here[0] if len(here) == 1 else here[0].union(here[1]), "index", "left_anti"))
                if new is not None or (gone is not None and not gone.isEmpty()):
                    self._put(o, old, new, gone)
            elif old is not None or new is not None:
                self._place(o, settle(new if old is None else old if new is None else old.union(new)))
        columns = ["method", "role", "port", "instance", "index", "expected"]
        keep = self._expected(m).join(instances, "instance", "left_semi").select(columns)
        vanished = self._expected(m).select("instance").distinct().join(instances, "instance", "left_anti")
        if stale is None:
            self._record(m, settle(keep), vanished)
            return
        keep = keep.join(stale, "instance", "left_anti").select(columns)
        for role, side in (("in", m.inputs), ("out", m.outputs)):
            for port, a in enumerate(side, 1):
                k = min(m.rank, a.count("*"))
                now = self.items(a).withColumn("key", F.slice("index", 1, k))
                saw = stale.withColumn("key", F.slice("instance", 1, k)).join(now, "key")
                keep = keep.union(saw.select(F.lit(m.name), F.lit(role), F.lit(port), "instance", "index", "actual"))
        resigned = self.signed.get(m.name) not in (None, m.signature)
        self.signed[m.name] = m.signature
        self._record(m, settle(keep), vanished.union(stale) if not resigned else keep.select("instance").union(vanished))

    def _record(self, m: Method, seen: DataFrame, touched: DataFrame) -> None:
        """What a method saw; with a root, the rows of the touched instances go to its table."""
        self.seen[m.name] = seen
        if self.root is not None:
            self._expectations().replace(touched.select(F.lit(m.name).alias("method"), "instance"), seen)

    def _recorded(self, artefact: str) -> DataFrame:
        """index, expected: the versions that the artefact's producer last made, or a source was last seen with."""
        m = self.producer(artefact)
        if m is None:
            return self.sources.get(artefact, self.spark.createDataFrame([], "index array<string>, expected string"))
        mine = (F.col("role") == "out") & (F.col("port") == m.outputs.index(artefact) + 1)
        return self._expected(m).filter(mine & F.col("expected").isNotNull()).select("index", "expected")

    def save(self, *artefacts: str, store: str | None = None, all_tracked: bool = False) -> int:
        """Puts contents of the artefacts (or of all in their provenance that were ever saved) into a store (or the default one), each
        once; returns how many were new there. Artefacts that aren't in place are passed over with a warning."""
        into = self.store(store)  # an unknown store is an error
        known = {a for m in self.methods.values() for a in (*m.inputs, *m.outputs)} | set(self.artefacts)
        if unknown := [a for a in artefacts if a not in known]:
            raise KeyError(f"no artefact is called {unknown[0]}")
        self.tracked |= set(artefacts)
        if all_tracked:
            above = {a for m in self.ordered([*artefacts]) for a in (*m.inputs, *m.outputs)} | set(artefacts)
            artefacts = tuple(sorted(above & self.tracked))
        rows = trees = None
        for a in artefacts:
            if a not in self.artefacts:
                warnings.warn(f"{a} is not in place and isn't saved", stacklevel=2)
                continue
            if self.producer(a) is None:
                self._record_source(a)
            if a.endswith("/"):  # only directories that the store lacks are read
                lacking = self.listed[a].join(into.versions(directories=True).withColumnRenamed("version", "actual"), "actual", "left_anti").dropDuplicates(["actual"])
                inside = self._read(a, lacking).join(lacking.select("index", F.col("actual").alias("version")), "index")
                inside = inside.select("version", "path", version(F.col("content")).alias("part"), "content")
                trees = inside if trees is None else trees.union(inside)
                continue
            if a not in self.listed:
                here = self.artefacts[a]
            else:  # only files that the store lacks are read
                lacking = self.listed[a].join(into.versions().withColumnRenamed("version", "actual"), "actual", "left_anti")
                here = self._read(a, lacking.dropDuplicates(["actual"]))
            part = here.select(version(F.col("content").cast("binary")).alias("version"), F.col("content").cast("binary").alias("content"))
            rows = part if rows is None else rows.union(part)
        if self.root is not None:
            self._keep_methods()
        if rows is None and trees is None:
            return 0
        return into.save(self.spark.createDataFrame([], "version string, content binary") if rows is None else rows, trees)

    def restore(self, artefact: str) -> int:
        """Puts the recorded version of an artefact in place from the stores; returns its number of elements. Nothing recorded, or
        a version that no store holds, is an error."""
        wanted = settle(self._recorded(artefact).distinct())
        if wanted.isEmpty():
            raise ValueError(f"nothing is recorded of {artefact}")
        here = self.items(artefact).withColumnRenamed("actual", "expected")
        lost = wanted.join(here, ["index", "expected"], "left_anti").join(self._held(), "expected", "left_anti").first()
        if lost is not None:
            raise LookupError(f"no store holds {lost['expected'][:8].lower()} of {artefact}")
        if artefact in self.artefacts:  # elements with another version give way
            same = settle(self.items(artefact).join(wanted, "index").filter("actual = expected").select("index"))
            if artefact in self.listed:
                here = self.listed[artefact]
                self._put(artefact, here.join(same, "index", "left_semi"), None, settle(here.select("index").join(same, "index", "left_anti")))
            else:
                self._place(artefact, settle(self.artefacts[artefact].join(same, "index", "left_semi")))
        self._fetch(artefact, wanted)
        return wanted.count()

    def sign(self, name: str) -> bool:
        """Accepts a method's present definition for what was recorded; returns whether that changed anything. A source has nothing to
        accept; a name that is neither's is an error."""
        if name not in self.methods:
            if self.producer(name) is None and (name in self.artefacts or name in self.sources or any(name in m.inputs for m in self.methods.values())):
                return False
            raise KeyError(f"no method is called {name}")
        changed = name in self.seen and self.signed.get(name) != self.methods[name].signature
        if changed:
            self.signed[name] = self.methods[name].signature
            if self.root is not None:
                self._keep_methods()
        return changed

    # -- state on disk

    def _documents(self) -> list[dict]:
        """A metadata document for each method and source."""
        link = lambda a: {"path": a, "version": None}
        return [
            {"tracked": bool(self.tracked & set(m.outputs)), "kind": "command", "command": m.text, "working_dir": "./", "output_index": 0, "signature": self.signed.get(m.name), "clean_outputs": True, "resource_groups": [], "success_codes": [0], "inputs": [link(a) for a in m.inputs], "outputs": [link(a) for a in m.outputs]}
            for m in self.methods.values()
        ] + [{"tracked": a in self.tracked, "kind": "source", "outputs": [link(a)], "inputs": []} for a in sorted({*self.sources, *self.artefacts}) if self.producer(a) is None]

    def _write_documents(self, folder: str) -> None:
        if documents := self._documents():
            metadata.write(self.spark.createDataFrame(documents, metadata.SCHEMA.replace("format int, ", "")), folder)

    def _write_head(self, folder: str, head: dict) -> None:
        system, path = filesystem(folder)
        with system.open_output_stream(f"{path}/state.new") as out:
            out.write(json.dumps(head | {"default": self.config.default, "stores": self.config.stores, "tracked": sorted(self.tracked), "kinds": self.kinds}).encode())
        system.move(f"{path}/state.new", f"{path}/state.json")

    def _keep_methods(self) -> None:
        """Writes the methods to the root: small documents, in a folder that counts when it is named."""
        state = f"methods-{uuid.uuid4().hex}"
        at = f"{self.root.rstrip('/')}/{FOLDER}"
        self._write_documents(f"{at}/{state}")
        self._write_head(at, {"methods": state})
        _delete_others(at, "methods-", {state})

    def _read_documents(self, folder: str, functions: dict[str, Function]) -> list[str]:
        """Takes methods and signatures from documents; returns the sources."""

        def missing(*_frames: DataFrame) -> DataFrame:
            raise LookupError("this method's function was not given")

        found = []
        for row in metadata.read(self.spark, folder).collect():  # one row a method
            outputs = tuple(o["path"] for o in row["outputs"])
            name = min(outputs)
            if row["kind"] == "source":
                found.append(name)
                continue
            self.methods[name] = Method(tuple(i["path"] for i in row["inputs"]), outputs, functions.get(name, missing), row["command"])
            if row["signature"] is not None:
                self.signed[name] = row["signature"]
        return found

    @classmethod
    def open(cls, spark: SparkSession, root: str, functions: dict[str, Function] | None = None, buckets: int = BUCKETS) -> Flow:
        """The flow of a root: its files, and what was recorded. functions: those of the methods, by name; a method without one stays known,
        and running it is an error. Jobs that were cut off while they put elements in place are completed first."""
        flow = cls(spark, root=root, config=open_root(root), buckets=buckets)
        files.recover(root, clean=False, spark=spark)
        at = f"{root.rstrip('/')}/{FOLDER}"
        system, path = filesystem(at)
        if not system.get_file_info(f"{path}/state.json").is_file:
            return flow
        with system.open_input_stream(f"{path}/state.json") as source:
            head = json.loads(source.read())
        flow.tracked = set(head["tracked"])
        sources = flow._read_documents(f"{at}/{head['methods']}", functions or {})
        recorded = settle(flow._expectations().read())
        for name in flow.methods:
            if name in flow.signed:
                flow.seen[name] = recorded.filter((F.col("role") != "source") & (F.col("method") == name))
        for name in sources:
            rows = recorded.filter((F.col("role") == "source") & (F.col("method") == name)).select("index", "expected")
            if not rows.isEmpty():
                flow.sources[name] = rows
        every = {a for m in flow.methods.values() for a in (*m.inputs, *m.outputs)} | set(sources)
        flow._scan({a: head["kinds"].get(a) == "string" for a in sorted(every)})
        return flow

    def write_state(self, folder: str) -> None:
        """Writes definitions (metadata documents), recorded versions and elements in place; contents stay in their stores. Parts that are as
        they were last written aren't written again. The new state counts when its head is written; parts that it doesn't
        name go."""
        parts: dict[str, dict[str, str]] = {"items": {}, "seen": {}, "sources": {}}
        written: dict[str, tuple[DataFrame, str]] = {}
        for kind, frames in (("items", self.artefacts), ("seen", self.seen), ("sources", self.sources)):
            for name, rows in frames.items():
                key = f"{kind} {name}"
                was = self._written.get(f"{folder} {key}")
                part = was[1] if was is not None and was[0] is rows else f"part-{uuid.uuid4().hex}"
                if was is None or was[0] is not rows:
                    rows.write.parquet(f"{folder}/{part}")
                written[f"{folder} {key}"] = (rows, part)
                parts[kind][name] = part
        state = f"part-{uuid.uuid4().hex}"
        self._write_documents(f"{folder}/{state}")
        self.store()  # relative stores have a place now
        self._write_head(folder, {"methods": state, "home": self._home, **parts})
        _delete_others(folder, "part-", {state, *(p for names in parts.values() for p in names.values())})
        self._written = written

    @classmethod
    def read_state(cls, spark: SparkSession, folder: str, functions: dict[str, Function]) -> Flow:
        """The flow that was written, in a session of its own. functions: those of the methods, by name; a method without one stays
        known, and running it is an error."""
        system, path = filesystem(folder)
        with system.open_input_stream(f"{path}/state.json") as source:
            head = json.loads(source.read())
        flow = cls(spark, config=Config(dict(head["stores"]), head["default"]), tracked=set(head["tracked"]), kinds=head["kinds"], _home=head["home"])
        flow._read_documents(f"{folder}/{head['methods']}", functions)
        for kind, frames in (("items", flow.artefacts), ("seen", flow.seen), ("sources", flow.sources)):
            for name, part in head[kind].items():
                frames[name] = spark.read.parquet(f"{folder}/{part}")
                flow._written[f"{folder} {kind} {name}"] = (frames[name], part)
        return flow

    def remove(self, artefact: str) -> None:
        """Forgets an artefact's elements in place, and deletes its files if the flow has a root (its recorded and stored versions stay).
        Directories are out of their places at once; deleting what is in them goes on in tasks beside what follows, until ``finish``."""
        if artefact in self.artefacts:
            rows = self.listed.pop(artefact) if artefact in self.listed else self.artefacts[artefact]
            del self.artefacts[artefact]
            self._publish(artefact, None, rows.select("index"))

    def finish(self) -> None:
        """Waits until all that was removed is deleted; an error of a deletion is raised here."""
        if self.root is not None:
            files.finish(self.root)


def _above(path: Column) -> Column:
    """The inner directories over a path."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    ks = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    return F.transform(ks, lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))


def _delete_others(folder: str, beginning: str, names: set[str]) -> None:
    """Deletes the folders with this beginning that aren't named."""
    from pyarrow.fs import FileSelector

    system, path = filesystem(folder)
    for x in system.get_file_info(FileSelector(path)):
        if x.base_name.startswith(beginning) and x.base_name not in names:
            system.delete_dir(x.path)
