"""Directories as artefacts: listed, hashed, made, stored and restored as wholes."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from driftloom.functions.fingerprints import directory_versions
from driftloom.plans.flow import Flow
from driftloom.sources import files, patterns, roots
from driftloom.sources.contents import EMPTY, ContentStore

TREE = {"in/a/x.txt": "1", "in/a/deep/er/y.txt": "2", "in/a/.hidden": "h", "in/a/x.txt.hash": "s", "in/b/x.txt": "1", "in/c/only/": None, "other/z.txt": "z"}


def put(root, tree):
    for name, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        if text is not None:
            with open(f"{root}/{name}", "w") as f:
                f.write(text)


def seen(root, top):
    """Files, and folders without any, under a folder; not what is hidden."""
    out = {}
    for folder, below, names in os.walk(f"{root}/{top}"):
        at = os.path.relpath(folder, root) + "/"
        if not below and not names:
            out[at] = None
        for n in names:
            if not n.startswith(".") and not n.endswith(".hash"):
                with open(f"{folder}/{n}") as f:
                    out[at + n] = f.read()
    return out


def digest(tree):
    """A directory's digest, from a dict of its files' texts and its directories' dicts."""
    parts = [(n, hashlib.sha512(v.encode()).digest()) for n, v in sorted(tree.items()) if isinstance(v, str)]
    parts += [(n, bytes.fromhex(digest(v))) for n, v in sorted(tree.items()) if isinstance(v, dict)]
    return hashlib.sha512("".join(n for n, _ in parts).encode() + b"".join(d for _, d in parts)).hexdigest().upper()


DIGESTS = {"a": digest({"x.txt": "1", "deep": {"er": {"y.txt": "2"}}}), "b": digest({"x.txt": "1"}), "c": digest({"only": {}})}


@pytest.fixture
def root(tmp_path):
    put(tmp_path, TREE)
    return str(tmp_path)


def marked(rows):
    """Files in capitals under up/, an empty directory beside."""
    done = rows.filter("content is not null").select("index", F.concat(F.lit("up/"), "path").alias("path"), F.concat("content", F.lit(b"!")).alias("content"))
    return done.union(rows.select("index", F.lit("none/"), F.lit(None).cast("binary")).distinct())


def names(rows):
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.col("path")))), ",")
    return rows.groupBy("index").agg(listed.alias("content"))


def test_listing_below(spark, root):
    listed = files.listing(spark, root, "in/*/").select("index").union(spark.createDataFrame([(["gone"],)], "index array<string>"))
    got = {(r["index"][0], r["path"]) for r in files.below(spark, root, "in/*/", listed).collect()}
    assert got == {("a", ""), ("a", "x.txt"), ("a", "deep/"), ("a", "deep/er/"), ("a", "deep/er/y.txt"), ("b", ""), ("b", "x.txt"), ("c", ""), ("c", "only/")}
    assert files.below(spark, root, "in/*/", listed.limit(0)).count() == 0


def test_versions(spark, root):
    version = lambda text: hashlib.sha512(text.encode()).hexdigest().upper()
    rows = [(["a"], "", None), (["a"], "x.txt", version("1")), (["a"], "deep/er/y.txt", version("2")), (["b"], "x.txt", version("1")), (["c"], "only/", None), (["d"], "", None)]
    got = {r["index"][0]: r["version"] for r in directory_versions(spark.createDataFrame(rows, "index array<string>, path string, version string")).collect()}
    assert got == {**DIGESTS, "d": EMPTY}


def test_only_the_pattern_s_directories_are_hashed(spark, root, monkeypatch):
    read = []
    real = patterns.file_versions
    monkeypatch.setattr(patterns, "file_versions", lambda r, wanted: (read.append(sorted(x[0] for x in wanted.select("relative").collect())), real(r, wanted))[1])
    versions = lambda: {r["relative"]: r["version"] for r in patterns.cached_versions(spark, root, {p: files.listing(spark, root, p) for p in ("in/*/", "other/*.txt")}).collect()}
    want = {f"in/{k}/": v for k, v in DIGESTS.items()} | {"other/z.txt": hashlib.sha512(b"z").hexdigest().upper()}
    assert versions() == want
    assert sorted(sum(read, [])) == ["in/a/deep/er/y.txt", "in/a/x.txt", "in/b/x.txt", "other/z.txt"]
    read.clear()
    assert versions() == want and not any(read)
    put(root, {"in/b/x.txt": "3"})
    os.utime(f"{root}/in/b/x.txt", (4e9, 4e9))
    os.remove(f"{root}/in/a/deep/er/y.txt")
    assert versions() == want | {"in/b/": digest({"x.txt": "3"}), "in/a/": digest({"x.txt": "1", "deep": {"er": {}}})}
    assert sum(read, []) == ["in/b/x.txt"]


def test_kinds_change_places(spark, root):
    """A file where a directory was, and the other way round; all of an element goes with what is hidden in it."""
    rows = [(["a"], "deep", b"file"), (["a"], "x.txt/", None), (["a"], "deep/", None), (["a"], "x.txt", None), (["b"], "", None)]
    made = [(i, p, b"" if p == "x.txt/" else c) for i, p, c in rows]
    files.write(spark.createDataFrame(made, "index array<string>, path string, content binary"), root, "in/*/")
    assert seen(root, "in") == {"in/a/deep": "file", "in/a/x.txt/": None, "in/c/only/": None}
    for path in ("../x", "/x", "a//b", ".x", "a/./b", "y.hash"):
        with pytest.raises(Exception, match="no path inside an element"):
            files.write(spark.createDataFrame([(["a"], path, b"")], "index array<string>, path string, content binary"), root, "in/*/")
    with pytest.raises(Exception, match="written twice"):
        files.write(spark.createDataFrame([(["a"], "x", b"1"), (["a"], "x", b"2")], "index array<string>, path string, content binary"), root, "in/*/")
    assert seen(root, "in") == {"in/a/deep": "file", "in/a/x.txt/": None, "in/c/only/": None}


def test_a_cut_off_job_of_directories_is_completed(spark, root, monkeypatch):
    """Deletions are carried out again after some elements were moved."""
    rows = [(["a"], "deep", b"file"), (["a"], "deep/", None), (["b"], "n.txt", b"n"), (["b"], "x.txt", None)]
    real = files.put_in_place
    monkeypatch.setattr(files, "put_in_place", lambda *_: None)
    files.write(spark.createDataFrame(rows, "index array<string>, path string, content binary"), root, "in/*/")
    monkeypatch.setattr(files, "put_in_place", real)
    (record,) = os.listdir(f"{root}/.driftloom/commits")
    job = record.removesuffix(".json")
    listings = [x for x in os.listdir(f"{root}/.driftloom/staging/{job}") if x.endswith(".list")]
    for listing in listings:
        files._carry_out(root, job, listing, True)
    files._carry_out(root, job, listings[0], False)
    assert files.recover(root, spark=spark) == 1
    assert seen(root, "in") == {"in/a/deep": "file", "in/a/x.txt": "1", "in/b/n.txt": "n", "in/c/only/": None}
    assert files.recover(root) == 0 and not os.listdir(f"{root}/.driftloom/staging")


def test_trees_share_contents(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], "version string, content binary")
    rows = [("T1", "", None, None), ("T1", "x", "V1", b"1"), ("T2", "", None, None), ("T2", "x", "V1", b"1"), ("T2", "y/", None, None), ("T2", "y/z", "V2", b"2")]
    schema = "version string, path string, part string, content binary"
    assert store.save(none, spark.createDataFrame(rows, schema)) == 4
    assert store.save(none, spark.createDataFrame(rows, schema)) == 0
    assert store.save(spark.createDataFrame([("V1", b"1"), ("V3", b"3")], "version string, content binary"), spark.createDataFrame([("T3", "", None, None), ("T3", "v", "V3", b"3")], schema)) == 2
    for _ in range(2):
        got = {tuple(r) for r in store.trees(spark.createDataFrame([("T2",), ("T9",), (EMPTY,)], "version string")).collect()}
        assert got == {("T2", "", None), ("T2", "x", "V1"), ("T2", "y/", None), ("T2", "y/z", "V2"), (EMPTY, "", None)}
        assert {(r[0], bytes(r[1])) for r in store.load(spark.createDataFrame([("V1",), ("V3",), ("T1",)], "version string")).collect()} == {("V1", b"1"), ("V3", b"3")}
        assert store.contents().count() == 3 and {r[0] for r in store.versions(directories=True).collect()} == {"T1", "T2", "T3"}
        store.compact()
        store.vacuum()


def test_a_flow_of_directories(spark, root):
    roots.initialise(root)
    made = {"out/*/": marked, "names/*.txt": names}

    def opened():
        flow = Flow.open(spark, root, made)
        flow.build(["in/*/"], ["out/*/"], marked, "marked")
        flow.build(["out/*/"], ["names/*.txt"], names, "names")
        flow.scan("in/*/")
        return flow

    out = {"out/a/up/x.txt": "1!", "out/a/up/deep/er/y.txt": "2!", "out/a/none/": None, "out/b/up/x.txt": "1!", "out/b/none/": None, "out/c/none/": None}
    listed = {"names/a.txt": "up/deep/er/y.txt,up/x.txt", "names/b.txt": "up/x.txt", "names/c.txt": ""}
    assert opened().compute("names/*.txt") == {"out/*/": 3, "names/*.txt": 3}
    assert seen(root, "out") == out and seen(root, "names") == listed
    assert Flow.open(spark, root, made).compute("names/*.txt") == {"out/*/": 0, "names/*.txt": 0}
    # a file of one directory goes: what was made of it goes with it, other directories stay
    time = os.stat(f"{root}/out/b/up/x.txt").st_mtime_ns
    os.remove(f"{root}/in/a/deep/er/y.txt")
    assert opened().compute("names/*.txt") == {"out/*/": 1, "names/*.txt": 1}
    del out["out/a/up/deep/er/y.txt"]
    assert seen(root, "out") == out and seen(root, "names") == listed | {"names/a.txt": "up/x.txt"}
    assert os.stat(f"{root}/out/b/up/x.txt").st_mtime_ns == time
    # a and b hold the same now: two directories and a content are stored
    flow = Flow.open(spark, root, made)
    assert flow.save("out/*/") == 3 and flow.save("out/*/") == 0
    flow.remove("out/*/")
    assert seen(root, "out") in ({}, {"out/": None})
    put(root, {"out/b/stray.txt": "s"})
    flow = Flow.open(spark, root, made)
    assert flow.restore("out/*/") == 3 and seen(root, "out") == out
    assert flow.compute("names/*.txt") == {"out/*/": 0, "names/*.txt": 0}
    # an instance that goes takes its directory with it
    import shutil

    shutil.rmtree(f"{root}/in/c")
    opened().compute("names/*.txt")
    assert "out/c/none/" not in seen(root, "out") and not os.path.exists(f"{root}/out/c") and not os.path.exists(f"{root}/names/c.txt")


def test_directories_need_a_root(spark):
    with pytest.raises(ValueError, match="root"):
        Flow(spark).build(["in/*/"], ["out.txt"], names, "names")


def batch(names, content=b"x"):
    import pyarrow as pa

    n = len(names)
    return pa.RecordBatch.from_arrays([pa.array(["d"] * n), pa.array(names), pa.array([content] * n, pa.binary())], ["index_1", "path", "content"])


def listing(root):
    """What the record of the only job names: lists, and their lines."""
    (record,) = os.listdir(f"{root}/.driftloom/commits")
    with open(f"{root}/.driftloom/commits/{record}") as f:
        lists = json.load(f)["made"]
    out = {}
    for x in lists:
        with open(f"{root}/.driftloom/staging/{record.removesuffix('.json')}/{x}") as f:
            out[x] = f.read().splitlines()
    return out


def test_a_new_directory_is_moved_in_one_step(root, monkeypatch):
    real = files.put_in_place
    monkeypatch.setattr(files, "put_in_place", lambda *_: None)
    writer = files.Writer({"root": root, "pattern": "new/*/"}, ["index_1", "path", "content"])
    writer.commit([writer.write(iter([batch([f"{i}.txt" for i in range(k, 300, 2)])])) for k in (0, 1)])
    lists = listing(root)
    assert len(lists) == 2 and all(len(lines) == 1 and json.loads(lines[0])[0] == "new/d/" for lines in lists.values())
    put(root, {"new/d/other.txt": "o", "new/d/7.txt": "7"})  # somebody made the directory meanwhile
    monkeypatch.setattr(files, "put_in_place", real)
    assert files.recover(root) == 1 and not os.listdir(f"{root}/.driftloom/staging")
    assert seen(root, "new") == {f"new/d/{i}.txt": "x" for i in range(300)} | {"new/d/other.txt": "o"}


def test_what_a_failed_attempt_staged_in_a_new_directory_is_left_out(root):
    writer = files.Writer({"root": root, "pattern": "new/*/"}, ["index_1", "path", "content"])
    writer.write(iter([batch(["a.txt", "b.txt", "gone/"], b"bad")]))
    writer.commit([writer.write(iter([batch(["b.txt", "c.txt", "deep/e.txt", "none/"])]))])
    assert seen(root, "new") == {"new/d/b.txt": "x", "new/d/c.txt": "x", "new/d/deep/e.txt": "x", "new/d/none/": None}
    assert not os.listdir(f"{root}/.driftloom/staging")


def test_many_directories_are_listed_in_many_tasks(spark, root):
    put(root, {f"many/{i}/x.txt": "x" for i in range(40)})
    listed = files.listing(spark, root, "many/*/").select("relative")
    found = patterns.entries(spark, root, listed)
    assert found.count() == 80 and found.filter("not directory").select(F.spark_partition_id()).distinct().count() > 4


def test_an_instance_that_runs_again_writes_what_changed(spark, root):
    roots.initialise(root)
    put(root, {f"in/a/{i}.txt": str(i) for i in range(6)})
    flow = Flow.open(spark, root)
    flow.build(["in/*/"], ["out/*/"], marked, "marked")
    flow.scan("in/*/")
    flow.compute("out/*/")
    Flow.open(spark, root, {"out/*/": marked})  # what is in place is hashed
    times = {i: os.stat(f"{root}/out/a/up/{i}.txt").st_mtime_ns for i in range(6)}
    put(root, {"in/a/3.txt": "new", "out/a/up/4.txt": "other"})
    for path in ("in/a/3.txt", "out/a/up/4.txt"):
        os.utime(f"{root}/{path}", (4e9, 4e9))
    os.remove(f"{root}/in/a/5.txt")
    flow = Flow.open(spark, root, {"out/*/": marked})
    assert flow.compute("out/*/") == {"out/*/": 1}
    out = {n.removeprefix("out/a/up/"): t for n, t in seen(root, "out/a/up").items()}
    assert out == {"0.txt": "0!", "1.txt": "1!", "2.txt": "2!", "3.txt": "new!", "4.txt": "4!", "x.txt": "1!", "deep/er/y.txt": "2!"}
    assert [os.stat(f"{root}/out/a/up/{i}.txt").st_mtime_ns == times[i] for i in range(5)] == [True, True, True, False, False]
    flow.save("out/*/")
    flow.remove("out/*/")
    flow.finish()
    assert not os.path.exists(f"{root}/out/a") and not os.listdir(f"{root}/.driftloom/staging")
    flow.restore("out/*/")
    assert {n.removeprefix("out/a/up/"): t for n, t in seen(root, "out/a/up").items()} == out
