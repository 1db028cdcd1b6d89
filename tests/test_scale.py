"""What grows with the tables: tasks for work on files, memory of one task."""

import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import lineage
from driftloom.sources import files, patterns
from driftloom.streaming import status


def names(spark, n):
    return spark.range(n).select(F.array(F.col("id").cast("string")).alias("index"), F.concat("id", F.lit(".txt")).alias("relative"))


def test_work_on_files_keeps_its_tasks_though_names_are_short(spark, tmp_path):
    n = 2 * spark.sparkContext.defaultParallelism
    files.write(names(spark, 300).select("index", F.lit("x").alias("content")), str(tmp_path), "*.txt")
    assert files.contents(str(tmp_path), names(spark, 300)).rdd.getNumPartitions() == n
    assert patterns.file_versions(str(tmp_path), names(spark, 300)).rdd.getNumPartitions() == n
    written = files.read(spark, str(tmp_path), "*.txt").filter("content = cast('x' as binary)")
    assert written.count() == 300


def test_a_writer_holds_one_content_at_a_time(tmp_path):
    content = pa.array([bytes(1 << 20)] * 48, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(48)]), content], ["index_1", "content"])
    writer = files.Writer({"root": str(tmp_path), "pattern": "*.bin"}, ["index_1", "content"])
    tracemalloc.start()
    try:
        writer.write(iter([batch]))
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_many_small_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(120):
        (tmp_path / "in" / f"f{i}").mkdir(parents=True)
        (tmp_path / "in" / f"f{i}" / "a.txt").write_text("x")
    rows = files.read(spark, str(tmp_path), "in/*/*.txt", content=False)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and rows.select("index_1").distinct().count() == 120


def test_a_task_stages_files_in_a_folder_of_its_own_and_lists_are_read_once(tmp_path, monkeypatch):
    root, n, steps, plain = str(tmp_path), 300, [], files._carry_out
    monkeypatch.setattr(files, "_carry_out", lambda root, job, listing, deleting: (steps.append(deleting), plain(root, job, listing, deleting))[1])
    for content, step in ((b"x", False), (None, True)):
        writer = files.Writer({"root": root, "pattern": "out/*.txt"}, ["index_1", "content"])
        message = writer.write(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([content] * n, pa.binary())], ["index_1", "content"])]))
        assert len(os.listdir(f"{root}/{writer.staging()}")) <= files.BESIDE + 2
        writer.commit([message])
        assert len(os.listdir(f"{root}/out")) == (0 if step else n) and steps == [step] and not os.listdir(f"{root}/.driftloom/staging")
        steps.clear()


def test_states_while_versions_arrive_are_kept_by_aggregates_and_repeats_give_no_row(spark, tmp_path):
    reports, marks, out = (str(tmp_path / x) for x in ("reports", "marks", "out"))
    batches = (
        [("a", "expected", "A", 1), ("a", "actual", "old", 1), ("b", "stored", "B", 1), ("c", "actual", None, 1)],
        [("a", "actual", "old", 2), ("a", "expected", "A", 2), ("b", "stored", "C", 2), ("c", "actual", None, 2)],
        [("a", "actual", "A", 3), ("b", "expected", "B", 3)],
        [("a", "actual", "late", 2), ("b", "expected", "C", 4), ("b", "stored", None, 4)],
    )
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, status.REPORT).coalesce(1).write.mode("append").parquet(reports)
        stream = spark.readStream.schema(status.REPORT).parquet(reports)
        assert "Python" not in (plan := status.states(stream)._jdf.queryExecution().logical().toString()) and "PySpark" not in plan
        status.follow(stream, marks, out)
        seen.append(sorted((r["element"], r["expected"] or "", r["actual"] or "", r["status"], r["turn"]) for r in spark.read.parquet(out).filter(F.col("batch") == len(seen)).collect()))
    assert seen == [
        [("a", "A", "old", "LocalUnexpected", 1), ("c", "", "", "LocalUnexpected", 1)],
        [],
        [("a", "A", "A", "Local", 2), ("b", "B", "", "Remote", 1)],
        [("b", "C", "", "Remote", 2)],
    ]


def plain_closure(edges, roots):
    depth, at, n = dict.fromkeys(roots, 0), set(roots), 0
    while at:
        n += 1
        at = {s for s, d in edges if d in at} - depth.keys()
        depth |= dict.fromkeys(at, n)
    return depth


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_closure_writes_no_edges_as_rows_and_finds_all_in_any_order_of_names(spark, monkeypatch, few):
    monkeypatch.setattr(lineage, "FEW", few)
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *_: pytest.fail("a checkpoint holds rows that no filter skips"))
    edges = [(f"n{i * 7 % 40}", f"n{i * 13 % 41}") for i in range(60)] + [("a", "z"), ("m", "a"), ("a", "m"), ("z", "m")]
    roots = ["z", "n5"]
    got = lineage.closure(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "node string")).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == sorted(plain_closure(edges, roots).items())


def test_a_closure_writes_no_edges_of_tables_and_reads_only_kinds_that_it_meets(spark, folder, monkeypatch):
    from driftloom.plans import catalogue

    names, plain = [], lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda rows, name="table": (names.append(name), plain(rows, name))[1])
    found = catalogue.QUERIES["tracked_closure"](spark, folder)
    assert found.count() > 0 and "edges" not in names
    lost = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("src"), F.lit("line/1").alias("dst"))
    parts = [("line/", lost), ("a/", spark.createDataFrame([("b/1", "a/1"), ("b/2", "a/2")], "src string, dst string")), ("b/", spark.createDataFrame([("a/2", "b/1")], "src string, dst string"))]
    got = lineage.closure(parts, spark.createDataFrame([("a/1",)], "node string")).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [("a/1", 0), ("a/2", 2), ("b/1", 1), ("b/2", 3)]


def test_doubling_joins_no_pointer_that_has_come_to_its_end(spark, monkeypatch):
    sizes, plain = [], lineage.settle
    monkeypatch.setattr(lineage, "settle", lambda rows: (out := plain(rows), sizes.append(out.count()))[0])
    rows = [(f"n{i}", None, 1) for i in range(200)] + [("c", "b", 1), ("b", "a", 1), ("a", None, 1)]
    got = {r["node"]: (r["up"], r["length"]) for r in lineage._doubled(spark.createDataFrame(rows, "node string, up string, length int")).collect()}
    assert got == {**{f"n{i}": (None, 1) for i in range(200)}, "a": (None, 1), "b": (None, 2), "c": (None, 3)}
    assert sizes[0] == 203 and max(sizes[1:]) <= 2
