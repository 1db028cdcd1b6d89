import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from driftloom.operators import lineage, staleness, store, vectors
from driftloom.sources import metadata, patterns, roots
from driftloom.streaming.incremental import each_arrival

TREE = {
    "raw/north/y21.csv": "a", "raw/north/y22.csv": "", "raw/south/y21.csv": "b", "raw/south/deep/er/z.csv": "c", "notes.v1.md": "", "raw/north/.draft.csv": "d", "raw/north/y21.hash": "e",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "raw/west").mkdir()
    return str(tmp_path)


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("raw/north/y21.csv", [""]), ("raw/north/*.csv", ["y21", "y22"]), ("raw/*/*.csv", ["north,y21", "north,y22", "south,y21"]),
        ("raw/south/*/er/*.csv", ["deep,z"]), ("*/*/*/*/*.csv", ["raw,south,deep,er,z"]), ("raw/*/", ["north", "south", "west"]), ("raw/south/*/er/", ["deep"]),
        ("*.md", ["notes"]), ("raw/west/*.csv", []), ("*/", ["raw"]),
    ],
)
def test_patterns(spark, tree, pattern, want):
    got = patterns.scan(patterns.entries(spark, tree), pattern).collect()
    assert sorted(",".join(r["index"]) for r in got) == want


def test_pattern_errors(spark, tree):
    listed = patterns.entries(spark, tree)
    for bad in ("a*/x.txt", "out*.txt", "*.a*"):
        with pytest.raises(ValueError, match="wildcard"):
            patterns.scan(listed, bad)
    for lost in ("raw/*/y22.csv", "raw/*/deep/"):
        with pytest.raises(FileNotFoundError, match="missing under"):
            patterns.scan(listed, lost)
    for name in ("a.b.csv", "a.c.csv"):
        with open(f"{tree}/raw/west/{name}", "w") as f:
            f.write("x")
    with pytest.raises(ValueError, match="several"):
        patterns.scan(patterns.entries(spark, tree), "raw/west/*.csv")


def test_deep_mtime(spark, tree):
    for i, name in enumerate(("raw/south/deep/er", "raw/south/deep", "raw/south", "raw/north", "raw/west", "raw", "raw/north/y21.csv", "raw/north/y22.csv", "raw/south/y21.csv", "raw/south/deep/er/z.csv", "notes.v1.md", "")):
        os.utime(f"{tree}/{name}", (1_000_000 + i, 1_000_000 + i))
    got = {r["relative"]: (int(r["t"]) - 1_000_000, r["n"]) for r in patterns.deep_mtime(patterns.entries(spark, tree)).select("relative", F.col("mtime").cast("long").alias("t"), "n").collect()}
    assert got == {"": (11, 5), "raw/": (9, 4), "raw/north/": (7, 2), "raw/south/": (9, 2), "raw/west/": (4, 0), "raw/south/deep/": (9, 1), "raw/south/deep/er/": (9, 1)}


def test_hashes_with_a_cache(spark, tree):
    sha = lambda text: hashlib.sha512(text.encode()).hexdigest().upper()
    items = patterns.scan(patterns.entries(spark, tree), "raw/*/*.csv")
    none = spark.createDataFrame([], "relative string, cached string, cache_mtime timestamp")
    versions, cache = patterns.hashed(spark, tree, items, none)
    want = {"raw/north/y21.csv": sha("a"), "raw/north/y22.csv": sha(""), "raw/south/y21.csv": sha("b")}
    assert dict(map(tuple, versions.collect())) == want
    old = datetime.datetime(1980, 1, 1)
    forged = spark.createDataFrame([("raw/north/y21.csv", "0" * 128, datetime.datetime(2090, 1, 1)), ("raw/south/y21.csv", "1" * 128, old), ("gone.csv", "2" * 128, old)], none.schema)
    versions, cache = patterns.hashed(spark, tree, items, forged)
    assert dict(map(tuple, versions.collect())) == want | {"raw/north/y21.csv": "0" * 128}
    assert {r["relative"] for r in cache.collect()} == set(want)


def test_roots(tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(f"{root}/a/b")
    assert roots.locate(f"{root}/a/b/c.txt") is None and not roots.is_root(root)
    with pytest.raises(ValueError, match="no experiment"):
        roots.artefact_for(f"{root}/a/x.txt")
    with pytest.raises(FileNotFoundError):
        roots.open_root(root)
    roots.initialise(root)
    with pytest.raises(FileExistsError):
        roots.initialise(root)
    assert roots.locate(f"{root}/a/b/c.txt") == root + "/" and roots.artefact_for(f"{root}/a/b/c.txt") == (root + "/", "a/b/c.txt")
    config = roots.open_root(root)
    config.put("far", "s3://bucket/x")
    config.put("far", "/elsewhere")
    config.set_default("far")
    roots.write_config(root, config)
    config = roots.open_root(root)
    assert config.folder(root) == "/elsewhere" and config.folder(root, "local") == f"{root}/.driftloom/store"
    config.remove("far")
    for bad in (lambda: config.folder(root), lambda: config.remove("far"), lambda: config.set_default("x")):
        with pytest.raises(KeyError, match="no store"):
            bad()
    (tmp_path / "r/.driftloom/config.json").write_text('{"format": 7}')
    with pytest.raises(ValueError, match="format 7"):
        roots.open_root(root)


S, E = store.SECTION_START, store.SECTION_END


@pytest.mark.parametrize(
    "lines,want",
    [
        ([], [S, "k/", "m", E]), (["x", "y"], ["x", "y", S, "k/", "m", E]), ([S, E], [S, "k/", "m", E]), (["x", S, "z", "a", E], ["x", S, "a", "k/", "m", "z", E]),
        ([S, "m", E, "t", "m"], [S, "k/", "m", E, "t", "m"]), (["h", S, E, "t"], ["h", S, "k/", "m", E, "t"]),
        ([S, S, E], None), ([E, S], None), ([S, E, S, E], None), ([S, E, E], None), ([E], None), ([S, "x"], None),
    ],
)
def test_ignore_list_section(spark, lines, want):
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos long, line string")
    out = store.with_entries(rows, spark.createDataFrame([("f", "m"), ("f", "k/"), ("f", "m")], "file string, entry string"))
    if want is None:
        with pytest.raises(Exception, match="malformed"):
            out.collect()
    else:
        assert [r["line"] for r in out.orderBy("pos").collect()] == want


def test_paths_to_restore(spark):
    rows = [
        ("i", "A", None, False, None, False, "A"), ("i", "A", "B", False, None, False, None), ("r", "A", None, True, None, False, None), ("r", "A", "A", True, None, False, None),
        ("q", "A", None, True, None, False, "A"), ("n", None, None, False, "P", False, "P"), ("n", None, "X", False, "P", False, None), ("n", None, None, False, None, False, None),
    ]
    df = spark.createDataFrame(rows, "instance string, expected string, actual string, free boolean, produced string, from_source boolean, want string")
    got = staleness.restorable(df, ["instance"]).collect()
    assert sorted((r["instance"], r["wanted"]) for r in got) == sorted((r[0], r[6]) for r in rows if r[6]) and all(r["wanted"] == r["want"] for r in got)
    with pytest.raises(Exception, match="neither in place nor recorded"):
        staleness.restorable(spark.createDataFrame([("s", None, None, False, None, True, None)], df.schema), ["instance"]).collect()


def test_source_status_and_texts(spark):
    df = spark.createDataFrame([("Local",), ("LocalUnexpected",), ("Remote",)], "s string")
    assert [r[0] for r in df.select(staleness.source_status(F.col("s"))).collect()] == ["Local", "Local", "Remote"]
    with pytest.raises(Exception, match="neither on disk"):
        spark.createDataFrame([("NotFound",)], "s string").select(staleness.source_status(F.col("s"))).collect()
    df = spark.createDataFrame([("UpToDate", "Local"), ("UpToDate", "Remote"), ("InputsOutdated", None)], "s string, l string")
    assert [r[0] for r in df.select(staleness.status_text(F.col("s"), F.col("l"))).collect()] == ["Up to date", "Up to date (in storage)", "Need recomputation"]


def test_graph_counts_and_registration(spark):
    link = spark.createDataFrame([("o", "in", 1, "a"), ("o", "in", 2, "b"), ("o", "out", 1, "o"), ("p", "in", 1, "o"), ("p", "out", 1, "p")], "method string, role string, port int, artefact string")
    assert tuple(lineage.counts(link).first()) == (4, 4)
    new = lineage.add_methods(link, spark.createDataFrame([("p", "out", 1, "p")], link.schema))
    assert new.count() == 4 and tuple(lineage.counts(new).first()) == (4, 4)


def test_metadata(spark, tmp_path):
    link = lambda path, v: {"path": path, "version": v}
    row = {"tracked": True, "kind": "command", "command": "c", "working_dir": "./", "output_index": 0, "signature": "S", "clean_outputs": True, "resource_groups": ["cpu"], "success_codes": [0], "inputs": [link("a.txt", '"V"'), link("d/*.txt", '{"1":"A","2":null}')], "outputs": [link("o/*.txt", None)]}
    df = spark.createDataFrame([row], metadata.SCHEMA.replace("format int, ", ""))
    metadata.write(df, str(tmp_path / "m"))
    links = metadata.links(metadata.read(spark, str(tmp_path / "m")))
    assert sorted((r["method"], r["role"], r["port"], r["artefact"]) for r in links.collect()) == [("o/*.txt", "in", 1, "a.txt"), ("o/*.txt", "in", 2, "d/*.txt"), ("o/*.txt", "out", 1, "o/*.txt")]
    flat = metadata.flattened(links.filter("artefact = 'd/*.txt'"), "version", 1)
    assert sorted((r["index"][0], r["value"]) for r in flat.collect()) == [("1", "A"), ("2", None)]
    (tmp_path / "old.json").write_text('{"format": 2}')
    with pytest.raises(Exception, match="unsupported metadata format"):
        metadata.read(spark, str(tmp_path / "old.json")).collect()


def test_decision_table(spark):
    rows = [
        ("never", None, "A", False), ("never", "A", "A", False), ("same", "A", "A", False), ("stored", "A", None, True), ("stored", "B", "B", False),
        ("lost", "A", None, False), ("lost", "B", None, True), ("other", "A", "X", True), ("other", "B", None, False),
    ]
    df = spark.createDataFrame(rows, "g string, expected string, actual string, in_store boolean")
    got = {r["g"]: (r["decision"], r["remote"]) for r in staleness.group_decision(df, ["g"]).collect()}
    assert got == {"never": ("SomeAreLocalUnexpected", 0), "same": ("AllExist", 0), "stored": ("AllExist", 1), "lost": ("SomeAreNotFound", 0), "other": ("SomeAreLocalUnexpected", 0)}


def test_hash_cache_is_strict(spark):
    t = datetime.datetime(2024, 1, 1)
    data = spark.createDataFrame([("a", t), ("b", t), ("c", t), ("d", t)], "path string, mtime timestamp")
    cache = spark.createDataFrame([("a", t), ("b", t + datetime.timedelta(1)), ("c", t - datetime.timedelta(1)), ("e", t)], "path string, cache_mtime timestamp")
    got = {r["path"]: r["state"] for r in staleness.fresh_hashes(data, cache, ["path"]).collect()}
    assert got == {"a": "stale", "b": "hit", "c": "stale", "d": "miss", "e": "orphan"}


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert sorted(r["node"] for r in lineage.closure(edges, spark.createDataFrame([("d",)], "node string")).collect()) == ["a", "b", "c", "d"]
    nodes = spark.createDataFrame([(n,) for n in "abcdxy"], "node string")
    assert {r["node"]: r["level"] for r in lineage.levels(edges, nodes).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": 0, "y": 1}
    with pytest.raises(ValueError, match="cycle"):
        lineage.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), nodes)


def test_vectors(spark):
    rows = spark.createDataFrame([(["a", "1"], "x"), (["a", "2"], "y"), (["b", "1"], "z")], "index array<string>, v string")
    wanted = spark.createDataFrame([(["a"],), (["b", "1", "q"],)], "index array<string>")
    assert sorted((r["wanted"][0], r["v"]) for r in vectors.at_prefix(rows, wanted).collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert vectors.same_rank(rows, "index").count() == 3
    with pytest.raises(Exception, match="different rank"):
        vectors.same_rank(rows.union(spark.createDataFrame([(["c"], "w")], rows.schema)), "index").collect()
    e = spark.createDataFrame([("p", 1, "A"), ("p", 2, "B"), ("q", 1, "C")], "art string, i int, expected string")
    a = spark.createDataFrame([("p", 1, "A"), ("p", 3, "D")], "art string, i int, actual string")
    got = {(r["art"], r["i"]): r["update_type"] for r in vectors.source_delta(e, a, ["art", "i"], ["art"]).collect()}
    assert got == {("p", 1): "Process", ("p", 2): "Delete", ("p", 3): "Process", ("q", 1): "Process"}


def test_each_arrival(spark, tmp_path):
    seen = []
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(folder)
        each_arrival(spark, folder, "id long", mark, lambda df, batch: seen.append(df.count()))
    assert seen == [3, 2]
