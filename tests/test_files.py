"""Files as artefacts: the data source, its writer, stores as logs of manifests, expectations in buckets, flows with a root."""

import glob
import hashlib
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from driftloom.plans.flow import Flow
from driftloom.sources import files, patterns, roots
from driftloom.sources.contents import Conflict, ContentStore
from driftloom.sources.expectations import Expectations


def put(root, tree):
    for name, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(text.encode())


TREE = {
    "in/eu/fr/paris.v2.txt": "p", "in/eu/fr/lyon.txt": "l", "in/eu/de/bonn.txt": "", "in/us/ny/albany.txt": "a", "in/us/ny/.hidden.txt": "h", "in/us/ny/albany.hash": "x", "in/eu/fr/note.md": "n", "one.txt": "1",
}


@pytest.fixture
def root(tmp_path):
    put(tmp_path, TREE)
    return str(tmp_path)


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("in/*/*/*.txt", {("eu", "fr", "paris"): b"p", ("eu", "fr", "lyon"): b"l", ("eu", "de", "bonn"): b"", ("us", "ny", "albany"): b"a"}),
        ("in/eu/fr/*.txt", {("paris",): b"p", ("lyon",): b"l"}), ("one.txt", {(): b"1"}), ("none.txt", {}), ("gone/*.txt", {}), ("gone/*/x.txt", {}), ("in/*/*/", {("eu", "fr"): None, ("eu", "de"): None, ("us", "ny"): None}), ("*.txt", {("one",): b"1"}),
    ],
)
def test_reading(spark, root, pattern, want):
    rows = files.read(spark, root, pattern).collect()
    rank = pattern.count("*")
    assert {tuple(r[:rank]): None if r["content"] is None else bytes(r["content"]) for r in rows} == want and len(rows) == len(want)
    if not pattern.endswith("/"):
        assert all(r["length"] == len(r["content"]) and TREE[r["relative"]].encode() == r["content"] for r in rows)


def test_reading_agrees_with_the_scan(spark, root):
    """Two ways to the same elements: tasks that walk the pattern, and a listing of the whole root."""
    listed = patterns.entries(spark, root)
    for pattern in ("in/*/*/*.txt", "in/*/*/", "*.txt", "in/eu/*/*.txt"):
        rank = pattern.count("*")
        got = {(tuple(r[:rank]), r["relative"], r["mtime"], r["length"]) for r in files.read(spark, root, pattern, content=False).collect()}
        assert got == {(tuple(r["index"]), r["relative"], r["mtime"], r["length"]) for r in patterns.scan(listed, pattern).collect()}


def test_errors_of_reading(spark, root):
    for bad in ("a*/x.txt", "out*.txt", "*.a*"):
        with pytest.raises(Exception, match="wildcard"):
            files.read(spark, root, bad).collect()
    with pytest.raises(Exception, match="missing under"):
        files.read(spark, root, "in/*/fr/*.txt").collect()
    put(root, {"in/eu/fr/lyon.old.txt": "2"})
    with pytest.raises(Exception, match="several files"):
        files.read(spark, root, "in/*/*/*.txt").collect()


def test_filters_reach_the_listing(root):
    def listed(*filters):
        reader = files.Reader({"root": root, "pattern": "in/*/*/*.txt"})
        left = list(reader.pushFilters(list(filters)))
        walk = files.Walk(root, "in/*/*/*.txt", reader.wanted)
        found = {x.relative for p in reader.partitions() for f in p.folders for x in walk.below(*f)}
        return len(left), set(walk.listed), found

    assert listed() == (0, {"in/eu/", "in/us/", "in/eu/fr/", "in/eu/de/", "in/us/ny/"}, {"in/eu/fr/paris.v2.txt", "in/eu/fr/lyon.txt", "in/eu/de/bonn.txt", "in/us/ny/albany.txt"})
    eq, within = lambda i, v: files.EqualTo((f"index_{i}",), v), lambda i, *v: files.In((f"index_{i}",), v)
    assert listed(eq(1, "us")) == (1, {"in/us/", "in/us/ny/"}, {"in/us/ny/albany.txt"})
    assert listed(eq(1, "eu"), eq(2, "fr"), within(3, "lyon", "x")) == (3, {"in/eu/fr/"}, {"in/eu/fr/lyon.txt"})
    assert listed(within(2, "fr", "../us/ny")) == (1, {"in/eu/fr/"}, {"in/eu/fr/paris.v2.txt", "in/eu/fr/lyon.txt"})
    assert listed(eq(1, "eu"), eq(1, "us"))[2] == set()


def test_filters_in_a_query(spark, root, capsys):
    df = files.read(spark, root, "in/*/*/*.txt").filter("index_1 = 'eu' and index_3 in ('lyon', 'bonn') and length(content) > 0")
    assert [r["relative"] for r in df.collect()] == ["in/eu/fr/lyon.txt"]


def test_a_folder_s_files_are_shared_by_tasks(spark, tmp_path):
    put(tmp_path, {f"d/{i}.bin": "x" * i for i in range(200)})
    df = files.read(spark, str(tmp_path), "d/*.bin")
    assert sorted((int(r["index_1"]), r["length"]) for r in df.collect()) == [(i, i) for i in range(200)]
    assert df.select(F.spark_partition_id()).distinct().count() == files.SHARES


def on_disk(root, under="out"):
    return {os.path.relpath(f, root): open(f, "rb").read() for f in glob.glob(f"{root}/{under}/**/*", recursive=True) if os.path.isfile(f)}


def test_writing_and_deleting(spark, root):
    rows = [(["a", str(i)], f"text {i}") for i in range(50)]
    files.write(spark.createDataFrame(rows, "index array<string>, content string"), root, "out/*/*.txt")
    want = {f"out/a/{i}.txt": f"text {i}".encode() for i in range(50)}
    assert on_disk(root) == want and os.listdir(f"{root}/.driftloom/staging") == [] and os.listdir(f"{root}/.driftloom/commits") == []
    files.write(spark.createDataFrame([(["a", "1"], "new"), (["b", "1"], ""), (["a", "2"], None), (["z", "z"], None)], "index array<string>, content string"), root, "out/*/*.txt")
    del want["out/a/2.txt"]
    assert on_disk(root) == want | {"out/a/1.txt": b"new", "out/b/1.txt": b""}
    files.write(spark.createDataFrame([([], "whole")], "index array<string>, content string"), root, "out/sum.txt")
    assert on_disk(root)["out/sum.txt"] == b"whole"


def test_a_failed_job_changes_nothing(spark, root):
    """The failing task has written elements before it ends, and so have others: none is seen."""
    files.write(spark.createDataFrame([(["1"], "old")], "index array<string>, content string"), root, "out/*.txt")
    rows = spark.range(400).select(F.array(F.col("id").cast("string")).alias("index"), F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.repeat(F.lit("x"), 10_000)).alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.write(rows, root, "out/*.txt")
    with pytest.raises(Exception, match="no part of an index"):
        files.write(spark.createDataFrame([(["2"], "x"), (["../../2"], "x")], "index array<string>, content string"), root, "out/*.txt")
    with pytest.raises(Exception, match="written twice"):
        files.write(spark.createDataFrame([(["2"], "x"), (["2"], "y")], "index array<string>, content string"), root, "out/*.txt")
    assert on_disk(root) == {"out/1.txt": b"old"}
    assert files.recover(root) == 0 and os.listdir(f"{root}/.driftloom/staging") == []


def test_a_commit_that_was_cut_off_is_completed(spark, root, monkeypatch):
    import pyarrow as pa

    files.write(spark.createDataFrame([(["3"], "old")], "index array<string>, content string"), root, "out/*.txt")
    writer = files.Writer({"root": root, "pattern": "out/*.txt"}, ["index_1", "content"])
    batch = pa.RecordBatch.from_pydict({"index_1": ["1", "2", "3"], "content": [b"one", b"two", None]})
    message = writer.write(iter([batch]))
    assert on_disk(root) == {"out/3.txt": b"old"}

    def cut_off(root, job):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(files, "put_in_place", cut_off)
        writer.commit([message])
    staged = [x for x in os.listdir(f"{root}/{writer.staging()}") if not x.endswith(".list")]
    os.makedirs(f"{root}/out", exist_ok=True)
    os.rename(f"{root}/{writer.staging()}/{sorted(staged)[0]}", f"{root}/out/1.txt")  # it had come as far as this
    assert files.recover(root) == 1 and on_disk(root) == {"out/1.txt": b"one", "out/2.txt": b"two"} and files.recover(root) == 0


# -- stores


def contents(spark, low, high):
    return spark.range(low, high).select(F.upper(F.sha2(F.col("id").cast("string"), 256)).alias("version"), F.col("id").cast("string").cast("binary").alias("content"))


def test_store_is_a_log(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"))
    assert store.versions().count() == 0 and store.load(contents(spark, 0, 2).select("version")).count() == 0
    assert store.save(contents(spark, 0, 30)) == 30 and store.save(contents(spark, 20, 40).union(contents(spark, 39, 40))) == 10
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/data/**/*.parquet", recursive=True)}
    assert store.save(contents(spark, 0, 40)) == 0 and store.state()[0] == 1  # nothing new: no manifest
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/s/data/**/*.parquet", recursive=True)} or store.vacuum() == 1
    got = store.load(contents(spark, 5, 7).select("version")).collect()
    assert sorted(bytes(r["content"]) for r in got) == [b"5", b"6"]
    assert store.save(contents(spark, 50, 52).union(spark.createDataFrame([(None, bytearray(b"x")), ("AB", None)], "version string, content binary"))) == 2


def test_versions_beginnings_prune_files(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path), digits=2)
    store.save(contents(spark, 0, 60))
    one = contents(spark, 7, 8)
    beginning = one.first()["version"][:2]
    for f in glob.glob(f"{tmp_path}/data/*/shard=*/*.parquet"):
        if f"shard={beginning}" not in f:
            with open(f, "wb") as out:
                out.write(b"broken")
    again = ContentStore(spark, str(tmp_path))
    assert again.digits == 2 and [bytes(r["content"]) for r in again.load(one.select("version")).collect()] == [b"7"]


def test_concurrent_saves_lose_nothing(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path))
    threads = [threading.Thread(target=store.save, args=(contents(spark, i * 5, i * 5 + 10),)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.versions().count() == 25 and store.state()[0] == 3
    # a number is given once, however many ask for it at a time
    taken, start = [], threading.Barrier(8)

    def take():
        start.wait()
        taken.append(store._take(9, {"add": [], "remove": []}))

    threads = [threading.Thread(target=take) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken) == [False] * 7 + [True]


def test_compaction_and_conflicts(spark, tmp_path, monkeypatch):
    from driftloom.sources import contents as module

    monkeypatch.setattr(module, "SUMMED", 3)
    store = ContentStore(spark, str(tmp_path))
    for i in range(4):
        store.save(contents(spark, i * 3, i * 3 + 4))
    live = store.state()[1]
    late = ContentStore(spark, str(tmp_path))
    assert store.compact() == 4 and len(store.state()[1]) == 1 and store.versions().count() == 13 == store.contents().count()
    with pytest.raises(Conflict):
        late.commit(["x"], live)
    assert store.compact() == 0 and late.versions().count() == 13
    assert store.vacuum() == 4 and late.load(contents(spark, 0, 20).select("version")).count() == 13


# -- expectations


def test_expectations_rewrite_few_buckets(spark, tmp_path):
    table = Expectations(spark, str(tmp_path), buckets=256)
    array = F.array((F.col("id") % 100).cast("string"), F.col("id").cast("string"))
    rows = spark.range(3000).select(F.lit("m").alias("method"), F.lit("out").alias("role"), F.lit(1).alias("port"), array.alias("instance"), array.alias("index"), F.lit("A").alias("expected"))
    assert table.read().count() == 0
    table.replace(rows, rows)
    files_of = lambda: set(glob.glob(f"{tmp_path}/rows/*/*.parquet"))
    before = files_of()
    one = rows.filter("instance[0] = '7'")  # one percent
    n = table.replace(one, one.filter("id % 200 = 7" if "id" in one.columns else "instance[1] % 200 = 7").withColumn("expected", F.lit("B")))
    gone = before - files_of()
    assert n <= 4 and len(gone) <= 4 and len(before) > 150 and len(gone) / len(before) < 0.03
    assert {r["expected"]: r["count"] for r in Expectations(spark, str(tmp_path)).read().groupBy("expected").count().collect()} == {"A": 2970, "B": 15}
    assert table.replace(one, one.limit(0)) == n and table.read().count() == 2970 and table.replace(one.limit(0), one) == 0
    none = spark.createDataFrame([("s", "out", 1, [], [], "X")], table.read().schema)
    table.replace(none, none)
    assert table.read().filter("method = 's'").first()["expected"] == "X"


# -- digests of directories


def plain_digest(folder):
    names = sorted(x for x in os.listdir(folder) if not x.startswith(".") and not x.endswith(".hash"))
    inside = [x for x in names if os.path.isfile(f"{folder}/{x}")]
    below = [x for x in names if os.path.isdir(f"{folder}/{x}")]
    raw = [hashlib.sha512(open(f"{folder}/{x}", "rb").read()).digest() for x in inside] + [bytes.fromhex(plain_digest(f"{folder}/{x}")) for x in below]
    return hashlib.sha512("".join(inside + below).encode() + b"".join(raw)).hexdigest().upper()


def test_directories_are_hashed_and_refreshed(spark, root, monkeypatch):
    os.mkdir(f"{root}/in/empty")
    wide = lambda: {r["relative"]: (r["version"], r["recomputed"]) for r in patterns.cached_digests(spark, root).collect()}
    right = lambda got: all(v == plain_digest(f"{root}/{k}") for k, (v, _) in got.items() if k == "" or k.endswith("/"))
    got = wide()
    assert right(got) and all(new for _, new in got.values()) and len({got[f"in/{x}/"][0] for x in ("eu", "us", "empty")}) == 3
    time.sleep(1.1)
    put(root, {"in/eu/fr/lyon.txt": "changed"})
    got = wide()
    assert right(got) and {k for k, (_, new) in got.items() if new} == {"", "in/", "in/eu/", "in/eu/fr/", "in/eu/fr/lyon.txt"}
    os.remove(f"{root}/in/us/ny/albany.txt")
    got = wide()
    assert right(got) and {k for k, (_, new) in got.items() if new} == {"", "in/", "in/us/", "in/us/ny/"}
    cached = {r["relative"] for r in patterns.read_cache(spark, root).collect()}
    assert cached == set(got) and len(os.listdir(f"{root}/.driftloom/hashes")) == 2
    items = patterns.scan(patterns.entries(spark, root), "in/*/*/")
    none = spark.createDataFrame([], "relative string, cached string, cache_mtime timestamp")
    versions, _ = patterns.hashed(spark, root, items, none)
    assert {r["relative"]: r["version"] for r in versions.collect()} == {k: got[k][0] for k in ("in/eu/fr/", "in/eu/de/", "in/us/ny/")}


def test_only_wanted_files_are_read(spark, tmp_path):
    put(tmp_path, {"a/work/q1/z.csv": "z", "b/other.csv": "o"})
    base = tmp_path / "a"
    os.symlink("/nowhere", f"{tmp_path}/a/work/q1/lost.bin")
    root = f"{base}/work/q1"
    put(root, {f"x{root}/deep.csv": "d"})  # the root's own name stands below the root again
    items = patterns.scan(patterns.entries(spark, root), "*.csv").union(patterns.scan(patterns.entries(spark, root), f"x{root}/*.csv"))
    none = spark.createDataFrame([], "relative string, cached string, cache_mtime timestamp")
    versions, _ = patterns.hashed(spark, root, items, none)
    sha = lambda t: hashlib.sha512(t.encode()).hexdigest().upper()
    assert {r["relative"]: r["version"] for r in versions.collect()} == {"z.csv": sha("z"), f"x{root}/deep.csv": sha("d")}


# -- flows with a root


def upper(rows):
    return rows.select("index", F.upper(F.decode("content", "UTF-8")).alias("content"))


def total(rows):
    ordered = F.array_sort(F.collect_list(F.struct("index", F.col("content").cast("string").alias("content"))))
    return rows.groupBy(F.array().cast("array<string>").alias("index")).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "+").alias("content"))


def test_a_flow_of_files(spark, root):
    roots.initialise(root)
    made = {"out/*/*/*.txt": upper, "sum.txt": total}

    def opened():
        flow = Flow.open(spark, root, made)
        flow.build(["in/*/*/*.txt"], ["out/*/*/*.txt"], upper, "upper")
        flow.build(["out/*/*/*.txt"], ["sum.txt"], total, "total")
        flow.scan("in/*/*/*.txt")
        return flow

    assert opened().compute("sum.txt") == {"out/*/*/*.txt": 4, "sum.txt": 1}
    assert on_disk(root) == {"out/eu/fr/paris.txt": b"P", "out/eu/fr/lyon.txt": b"L", "out/eu/de/bonn.txt": b"", "out/us/ny/albany.txt": b"A"} and open(f"{root}/sum.txt").read() == "+L+P+A"
    flow = Flow.open(spark, root, made)  # knows methods, files and what was seen
    assert flow.compute("sum.txt") == {"out/*/*/*.txt": 0, "sum.txt": 0}
    # what is as it was when it was hashed isn't read again
    for f in ("in/eu/fr/paris.v2.txt", "out/us/ny/albany.txt"):
        was = os.stat(f"{root}/{f}")
        put(root, {f: "not looked at"})
        os.utime(f"{root}/{f}", ns=(was.st_atime_ns, was.st_mtime_ns))
    assert Flow.open(spark, root, made).compute("sum.txt") == {"out/*/*/*.txt": 0, "sum.txt": 0}
    for f, text in (("in/eu/fr/paris.v2.txt", "p"), ("out/us/ny/albany.txt", "A")):
        was = os.stat(f"{root}/{f}")
        put(root, {f: text})
        os.utime(f"{root}/{f}", ns=(was.st_atime_ns, was.st_mtime_ns))
    # one element changes, one goes
    times = {f: os.stat(f"{root}/{f}").st_mtime_ns for f in on_disk(root)}
    put(root, {"in/eu/fr/lyon.txt": "new"})
    os.remove(f"{root}/in/us/ny/albany.txt")
    assert opened().compute("sum.txt") == {"out/*/*/*.txt": 1, "sum.txt": 1}
    assert on_disk(root) == {"out/eu/fr/paris.txt": b"P", "out/eu/fr/lyon.txt": b"NEW", "out/eu/de/bonn.txt": b""} and open(f"{root}/sum.txt").read() == "+NEW+P"
    assert os.stat(f"{root}/out/eu/fr/paris.txt").st_mtime_ns == times["out/eu/fr/paris.txt"]
    # what was saved comes back when its files are gone
    flow = Flow.open(spark, root, made)
    assert flow.save("out/*/*/*.txt", "sum.txt") == 4
    assert len(os.listdir(f"{root}/.driftloom/store/log")) == 1
    flow.remove("sum.txt")
    flow.remove("out/*/*/*.txt")
    assert on_disk(root) == {} and not os.path.exists(f"{root}/sum.txt")
    flow = Flow.open(spark, root, made)
    assert flow.restore("out/*/*/*.txt") == 3 and len(on_disk(root)) == 3 and flow.tracked == {"out/*/*/*.txt", "sum.txt"}
    assert flow.compute("sum.txt") == {"out/*/*/*.txt": 0, "sum.txt": 0} and open(f"{root}/sum.txt").read() == "+NEW+P"
