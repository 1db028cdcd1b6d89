"""Chains, element-wise states, nested vectors, table functions, archives as streams, and states while versions arrive."""

import io
import random
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.functions import fingerprints
from driftloom.operators import lineage, staleness, store, vectors
from driftloom.plans.flow import Flow
from driftloom.sources import tables
from driftloom.streaming import status


def plain_levels(edges, nodes):
    level = {n: 0 for n in nodes}
    for _ in nodes:
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    return level


def leveled(spark, edges, nodes):
    return {r["node"]: r["level"] for r in lineage.levels(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}


def test_levels_are_longest_paths(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = sorted({(nodes[a], nodes[b]) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(45))})
    assert leveled(spark, edges, nodes) == plain_levels(edges, nodes)
    diamonds = [(f"d{i}", f"{x}{i}") for i in range(4) for x in "lr"] + [(f"{x}{i}", f"d{i + 1}") for i in range(4) for x in "lr"]
    names = sorted({n for e in diamonds for n in e})
    assert leveled(spark, diamonds, names) == plain_levels(diamonds, names)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, calls = 300, []
    monkeypatch.setattr(lineage, "settle", lambda df: calls.append(1) or tables.settle(df))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    assert leveled(spark, edges, [f"c{i}" for i in range(n + 1)]) == {f"c{i}": i for i in range(n + 1)}
    assert len(calls) < 20


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "a")], [("s", "a"), ("a", "b"), ("b", "c"), ("c", "a")], [("s", "a"), ("a", "b"), ("b", "a"), ("s", "b")], [("a", "a")]])
def test_cycles_are_errors(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        leveled(spark, edges, sorted({n for e in edges for n in e}))


def test_states_of_instances(spark):
    own = [("map", ["a", "1"], "UpToDate"), ("map", ["a", "2"], "OutputsOutdated"), ("map", ["b", "1"], "UpToDate"), ("sum", ["a"], "UpToDate"), ("sum", ["b"], "UpToDate"), ("split", ["a", "x"], "UpToDate"), ("split", ["b", "y"], "OutputsOutdated"), ("split", ["c", "z"], "UpToDate"), ("end", [], "UpToDate"), ("zero", [], "OutputsOutdated"), ("wide", ["q"], "UpToDate"), ("alone", ["a"], "UpToDate")]
    edges = [("map", "sum", 1), ("sum", "split", 1), ("split", "end", 0), ("zero", "wide", 0)]
    got = staleness.propagate_elements(spark.createDataFrame(own, "method string, instance array<string>, status string"), spark.createDataFrame(edges, "producer string, consumer string, shared int"))
    want = {("map", "a/1"): "U", ("map", "a/2"): "O", ("map", "b/1"): "U", ("sum", "a"): "I", ("sum", "b"): "U", ("split", "a/x"): "I", ("split", "b/y"): "O", ("split", "c/z"): "U", ("end", ""): "I", ("zero", ""): "O", ("wide", "q"): "I", ("alone", "a"): "U"}
    assert {(r["method"], "/".join(r["instance"])): r["status"][0] for r in got.collect()} == want


def test_a_flow_s_states_by_instance(spark):
    rows = lambda values: spark.createDataFrame([(list(k), v) for k, v in values.items()], "index array<string>, content string")
    flow = Flow(spark)
    flow.source("in/*.txt", rows({("1",): "a b", ("2",): "c"}))
    flow.build(["in/*.txt"], ["words/*/*.txt"], lambda d: vectors.scatter_table(d.select(d["index"][0].alias("i"), "content"), ["i"], "content", "content", lambda text: text.split(" ")).select(F.array("i", F.col("position").cast("string")).alias("index"), F.col("piece").alias("content")), "words")
    flow.build(["words/*/*.txt"], ["caps/*/*.txt"], lambda d: d.select("index", F.upper("content").alias("content")), "upper")
    assert flow.compute("caps/*/*.txt") == {"words/*/*.txt": 2, "caps/*/*.txt": 3}
    assert {tuple(r["index"]): r["content"] for r in flow.artefacts["caps/*/*.txt"].collect()} == {("1", "0"): "A", ("1", "1"): "B", ("2", "0"): "C"}
    flow.source("in/*.txt", rows({("1",): "a b", ("2",): "new"}))
    states = {name: {tuple(r["instance"]): r["state"] for r in df.collect()} for name, df in flow.status("caps/*/*.txt").items()}
    assert states == {"words/*/*.txt": {("1",): "UpToDate", ("2",): "InputsOutdated"}, "caps/*/*.txt": {("1", "0"): "UpToDate", ("1", "1"): "UpToDate", ("2", "0"): "InputsOutdated"}}


def test_binary_contents(spark):
    flow = Flow(spark)
    raw = {("1",): bytes([0, 255, 1]), ("2",): b""}
    flow.source("in/*.bin", spark.createDataFrame([(list(k), bytearray(v)) for k, v in raw.items()], "index array<string>, content binary"))
    flow.build(["in/*.bin"], ["out/*.bin"], lambda d: d.select("index", F.concat("content", "content").alias("content")), "twice")
    assert flow.compute("out/*.bin") == {"out/*.bin": 2} and flow.save("in/*.bin", "out/*.bin") == 3
    flow.remove("in/*.bin")
    assert flow.restore("in/*.bin") == 2 and {tuple(r["index"]): bytes(r["content"]) for r in flow.artefacts["in/*.bin"].collect()} == raw


def test_levels_of_a_vector(spark):
    leaves = spark.createDataFrame([(["b", "2"], 1), (["b", "10"], 2), (["a", "x"], None)], "index array<string>, v int")
    parents = spark.createDataFrame([(["a"],), (["c"],)], "index array<string>")
    once = vectors.reduce_level(leaves, 2, "v", parents)
    assert {r["index"][0]: [tuple(x) for x in r["values"]] for r in once.collect()} == {"b": [("10", 2), ("2", 1)], "a": [("x", None)], "c": []}
    twice = vectors.reduce_level(once, 1, "values").collect()
    assert len(twice) == 1 and twice[0]["index"] == [] and [(x["key"], len(x["value"])) for x in twice[0]["values"]] == [("a", 1), ("b", 2), ("c", 0)]
    for bad in (["b"], ["b", "2", "q"], []):
        with pytest.raises(Exception, match="ragged"):
            vectors.reduce_level(leaves.union(spark.createDataFrame([(bad, 5)], leaves.schema)), 2, "v").collect()
    assert vectors.reduce_level(leaves.limit(0), 2, "v").collect() == []


def test_a_table_function_counts_through_a_partition(spark):
    rows = spark.createDataFrame([(1, 2, "c d"), (1, 1, "a b"), (2, 1, None), (2, 2, "e"), (None, 1, "f")], "k int, t int, text string")
    out = vectors.scatter_table(rows, ["k"], "t", "text", lambda text: text.split(" "))
    assert out.dtypes == [("k", "int"), ("position", "bigint"), ("piece", "string")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "e"), (None, 0, "f")], key=str)


# -- archives


def test_parts_by_size_and_round_trip(spark):
    rows = [("d", f"sub/é{i:02d}.bin", bytearray(bytes([i]) * (i * 10))) for i in range(40)] + [("one", "f", bytearray(b"")), ("big", "g", bytearray(b"x" * 5000)), ("big", "h", bytearray(b"y"))]
    files = spark.createDataFrame(rows, "version string, name string, content binary").withColumn("size", F.octet_length("content"))
    runs = store.archive_runs(files, ["version"], "name", "size", 1000)
    parts = {}
    for r in runs.collect():
        parts.setdefault((r["version"], r["part"]), []).append(r["name"])
    sizes = {(v, n): len(c) for v, n, c in rows}
    assert all(names == sorted(names) for names in map(sorted, parts.values())) and all(sum(sizes[v, n] for n in sorted(names)[:-1]) <= 1000 for (v, _), names in parts.items())
    assert len(parts) > 6
    packed = store.archive(files.join(runs, ["version", "name"]), ["version"], "name")
    back = store.extract(packed, ["version"], "name").collect()
    assert sorted((r["version"], r["name"], bytes(r["content"])) for r in back) == sorted((v, n, bytes(c)) for v, n, c in rows)


def test_memory_of_archiving_does_not_grow_with_a_directory():
    def batches(n):
        for i in range(n):
            yield pa.RecordBatch.from_pydict({"version": ["d"], "part": pa.array([0], pa.int64()), "name": [f"{i:06d}"], "content": [random.Random(i).randbytes(200_000)]})

    def peak(n):
        tracemalloc.start()
        chunks = 0
        for batch in store.zipped(["version", "part"], "name", 64 << 10)(batches(n)):
            chunks += batch.num_rows
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return chunks, top

    (few, small), (many, large) = peak(10), peak(150)
    assert many > 10 * few and large < small + 1_000_000
    whole = b"".join(b.column("data")[0].as_py() for b in store.zipped(["version", "part"], "name", 1000)(batches(3)))
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        assert z.namelist() == ["000000", "000001", "000002"] and z.read("000001") == random.Random(1).randbytes(200_000) and z.testzip() is None


# -- digests of large and small parents


@pytest.mark.parametrize("limit", [0, 2000, 8 << 20])
def test_merkle_of_small_and_large_parents_agree(spark, monkeypatch, limit):
    import hashlib

    monkeypatch.setattr(fingerprints, "SMALL_PARENT", limit)
    rows = [(p, f"n{i:03d}" if i != 3 else None, f"{i:064x}".upper() if i != 5 else None) for p, n in (("a", 5), ("b", 100), (None, 7)) for i in range(n)]
    got = {r["p"]: (r["n"], r["version"]) for r in fingerprints.merkle(spark.createDataFrame(rows, "p string, name string, v string"), ["p"], "name", "v", 256).collect()}
    for p in ("a", "b", None):
        mine = sorted((n is not None, n or "", v or "") for q, n, v in rows if q == p)
        raw = "".join(n for _, n, _ in mine).encode() + b"".join(bytes.fromhex(v) for _, _, v in mine)
        assert got[p] == (len(mine), hashlib.sha256(raw).hexdigest().upper())


# -- states while versions arrive


def test_states_of_two_batches_are_those_of_one(spark, tmp_path):
    reports, marks, out = (str(tmp_path / x) for x in ("reports", "marks", "out"))
    first = [("a", "expected", "A", 1), ("a", "actual", "A", 1), ("b", "expected", "B", 1), ("c", "actual", "C", 1), ("d", "expected", "D", 1), ("d", "actual", "X", 1), ("e", "stored", "E", 1)]
    second = [("a", "actual", None, 2), ("b", "stored", "B", 2), ("c", "expected", "C", 2), ("d", "actual", "old", 0), ("e", "expected", "E", 2), ("f", "actual", "F", 2), ("f", "actual", None, 3), ("a", "expected", "A", 2)]
    seen = []
    for rows in (first, second):
        spark.createDataFrame(rows, status.REPORT).coalesce(1).write.mode("append").parquet(reports)
        status.follow(spark.readStream.schema(status.REPORT).parquet(reports), marks, out)
        seen.append({r["element"]: (r["expected"], r["actual"], r["status"]) for r in status.latest(spark.read.parquet(out)).collect()})
    assert seen[0] == {"a": ("A", "A", "Local"), "b": ("B", None, "NotFound"), "c": (None, "C", "LocalUnexpected"), "d": ("D", "X", "LocalUnexpected")}
    rows = {}
    for element, kind, version, _ in sorted(first + second, key=lambda r: r[3]):
        rows.setdefault(element, {"expected": None, "actual": None, "stored": set()})
        if kind == "stored":
            rows[element]["stored"].add(version)
        else:
            rows[element][kind] = version
    batch = spark.createDataFrame([(e, r["expected"], r["actual"], r["expected"] in r["stored"]) for e, r in rows.items()], "element string, expected string, actual string, in_store boolean")
    assert seen[1] == {r["element"]: (r["expected"], r["actual"], r["status"]) for r in batch.withColumn("status", staleness.link_status(batch)).collect()}
    before = spark.read.parquet(out).count()
    status.follow(spark.readStream.schema(status.REPORT).parquet(reports), marks, out)
    assert spark.read.parquet(out).count() == before
