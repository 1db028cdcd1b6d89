"""Recomputation scenarios: the status table of a chain of two methods, and vectors."""

import pytest
from pyspark.sql import functions as F

from driftloom.plans.flow import Flow

L, R, I, O = "UpToDate", "UpToDate", "InputsOutdated", "OutputsOutdated"


def rows(spark, values):
    return spark.createDataFrame([(list(k), v) for k, v in values.items()], "index array<string>, content string")


def concat(a, b):
    return a.select("index", F.col("content").alias("x")).crossJoin(b.select(F.col("content").alias("y"))).select("index", F.concat("x", "y").alias("content"))


@pytest.fixture
def chain(spark):
    flow = Flow(spark)
    for i in (1, 2, 3):
        flow.source(f"{i}.txt", rows(spark, {(): f"File {i}"}))
    flow.build(["1.txt", "2.txt"], ["1_2.txt"], concat, "concat")
    flow.build(["1_2.txt", "3.txt"], ["1_2_3.txt"], concat, "concat")
    return flow


def states(flow):
    return tuple(df.first()["state"] for df in flow.status("1_2_3.txt").values())


def text(flow, artefact):
    return {tuple(r["index"]): r["content"] for r in flow.artefacts[artefact].collect()}


def test_chain(spark, chain):
    assert states(chain) == (I, I)
    assert chain.compute("1_2_3.txt") == {"1_2.txt": 1, "1_2_3.txt": 1} and text(chain, "1_2_3.txt") == {(): "File 1File 2File 3"}
    assert states(chain) == (L, L) and chain.compute("1_2_3.txt") == {"1_2.txt": 0, "1_2_3.txt": 0}
    chain.source("3.txt", rows(spark, {(): "new"}))
    assert states(chain) == (L, I)
    chain.compute("1_2_3.txt")
    chain.source("2.txt", rows(spark, {(): "new"}))
    assert states(chain) == (I, I)
    chain.compute("1_2_3.txt")
    chain.artefacts["1_2_3.txt"] = rows(spark, {(): "by hand"})
    assert states(chain) == (L, O)
    chain.compute("1_2_3.txt")
    chain.build(["3.txt", "1_2.txt"], ["1_2_3.txt"], concat, "concat")
    assert states(chain)[0] == L and states(chain)[1] in (I, O)
    chain.compute("1_2_3.txt")
    assert text(chain, "1_2_3.txt") == {(): "newFile 1new"} and states(chain) == (L, L)
    chain.remove("1_2.txt")
    assert states(chain) == (O, I)


def test_chain_restores(spark, chain):
    chain.compute("1_2_3.txt")
    assert chain.save("1.txt", "2.txt", "3.txt", "1_2.txt", "1_2_3.txt") == 5 and chain.save("1.txt") == 0
    chain.remove("1_2.txt")
    assert states(chain) == (R, L) and chain.compute("1_2_3.txt") == {"1_2.txt": 0, "1_2_3.txt": 0}
    assert "1_2.txt" not in chain.artefacts  # not needed, so not fetched
    for a in list(chain.artefacts):
        chain.remove(a)
    assert states(chain) == (R, R)
    chain.compute("1_2_3.txt")
    assert text(chain, "1_2_3.txt") == {(): "File 1File 2File 3"}


def reduce_all(df):
    ordered = F.array_sort(F.collect_list(F.struct("index", "content")))
    return df.groupBy(F.array().cast("array<string>").alias("index")).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("content"))


@pytest.fixture
def vector(spark):
    flow = Flow(spark)
    flow.source("base.txt", rows(spark, {(): "Base"}))
    flow.source("data/*.txt", rows(spark, {("1",): "1", ("2",): "2", ("3",): "3"}))
    flow.build(["data/*.txt", "base.txt"], ["out/*.txt"], lambda d, b: concat(d, b), "concat")
    return flow


def test_vector_map_edit_shrink_rename(spark, vector):
    assert vector.compute("out/*.txt") == {"out/*.txt": 3} and text(vector, "out/*.txt") == {("1",): "1Base", ("2",): "2Base", ("3",): "3Base"}
    vector.source("data/*.txt", rows(spark, {("1",): "one", ("2",): "2", ("3",): "3"}))
    assert vector.compute("out/*.txt") == {"out/*.txt": 1} and text(vector, "out/*.txt")[("1",)] == "oneBase"
    vector.source("data/*.txt", rows(spark, {("1",): "one", ("4",): "2"}))
    assert vector.compute("out/*.txt") == {"out/*.txt": 1} and text(vector, "out/*.txt") == {("1",): "oneBase", ("4",): "2Base"}


def test_vector_gone_but_stored(spark, vector):
    vector.compute("out/*.txt")
    vector.save("data/*.txt", "out/*.txt")
    vector.remove("data/*.txt")
    vector.remove("out/*.txt")
    vector.compute("out/*.txt")
    assert len(text(vector, "out/*.txt")) == 3


def test_scatter_map_zip_reduce(spark, vector):
    vector.build([], ["samples/*.txt"], lambda s: rows(s, {(str(i),): f"s{i}" for i in (1, 2, 3)}), "three")
    vector.build(["samples/*.txt", "out/*.txt"], ["both/*.txt"], lambda a, b: a.join(b.withColumnRenamed("content", "c"), "index").select("index", F.concat("content", "c").alias("content")), "append")
    vector.build(["both/*.txt"], ["summary.txt"], reduce_all, "join")
    assert vector.compute("summary.txt") == {"samples/*.txt": 1, "out/*.txt": 3, "both/*.txt": 3, "summary.txt": 1}
    assert text(vector, "summary.txt") == {(): "s11Bases22Bases33Base"}
    vector.source("data/*.txt", rows(spark, {("1",): "1", ("3",): "3"}))
    assert vector.compute("summary.txt") == {"samples/*.txt": 0, "out/*.txt": 0, "both/*.txt": 0, "summary.txt": 1}
    assert text(vector, "summary.txt") == {(): "s11Bases33Base"}


def test_errors(spark, chain):
    with pytest.raises(ValueError, match="itself"):
        chain.build(["1_2_3.txt"], ["1.txt"], concat, "concat")
    with pytest.raises(ValueError, match="another method"):
        chain.build(["1.txt"], ["0.txt", "1_2.txt"], concat, "concat")


def test_another_function_voids_what_was_recorded(spark, chain):
    chain.compute("1_2_3.txt")
    chain.build(["1_2.txt", "3.txt"], ["1_2_3.txt"], lambda a, b: concat(b, a), "concat the other way round")
    assert states(chain) == (L, O) and chain.sign("1_2_3.txt") and states(chain) == (L, L) and not chain.sign("1_2_3.txt")
    assert not chain.sign("3.txt")  # a source
    with pytest.raises(KeyError):
        chain.sign("nothing.txt")


def test_an_input_that_a_method_never_saw_is_restored(spark, chain):
    chain.compute("1_2.txt")
    chain.save("1_2.txt")
    chain.remove("1_2.txt")
    assert chain.compute("1_2_3.txt") == {"1_2.txt": 0, "1_2_3.txt": 1}
    assert text(chain, "1_2_3.txt") == {(): "File 1File 2File 3"}


def test_saving_and_restoring(spark, chain, tmp_path):
    with pytest.raises(KeyError, match="no store"):
        chain.save("1.txt", store="far")
    with pytest.raises(KeyError, match="no artefact"):
        chain.save("7.txt")
    with pytest.warns(UserWarning, match="1_2.txt is not in place"):
        assert chain.save("1_2.txt") == 0
    chain.config.put("far", str(tmp_path / "far"))
    chain.compute("1_2_3.txt")
    assert chain.save("1_2.txt", store="far") == 1 and chain.save("1.txt") == 1 and chain.tracked == {"1.txt", "1_2.txt"}
    assert chain.save("1_2_3.txt", all_tracked=True) == 2  # with 1_2.txt, which the default store lacks
    chain.artefacts["1_2.txt"] = rows(spark, {(): "by hand"})
    assert chain.restore("1_2.txt") == 1 and text(chain, "1_2.txt") == {(): "File 1File 2"}
    chain.remove("1.txt")
    assert chain.restore("1.txt") == 1 and text(chain, "1.txt") == {(): "File 1"}
    chain.remove("2.txt")
    with pytest.raises(LookupError, match="no store holds"):
        chain.restore("2.txt")
    with pytest.raises(ValueError, match="nothing is recorded"):
        chain.restore("unknown.txt")


def test_state_survives_the_session(spark, vector, tmp_path):
    vector.build(["out/*.txt"], ["summary.txt"], reduce_all, "join")
    vector.compute("summary.txt")
    vector.save("data/*.txt")
    vector.write_state(str(tmp_path))
    made = {"out/*.txt": lambda d, b: concat(d, b), "summary.txt": reduce_all}
    again = Flow.read_state(spark, str(tmp_path), made)
    assert {r["state"] for df in again.status("summary.txt").values() for r in df.collect()} == {"UpToDate"} and again.tracked == {"data/*.txt"}
    again.source("data/*.txt", rows(spark, {("1",): "1", ("3",): "new"}))
    assert again.compute("summary.txt") == {"out/*.txt": 1, "summary.txt": 1} and text(again, "summary.txt") == {(): "1BasenewBase"}
    again.write_state(str(tmp_path))
    last = Flow.read_state(spark, str(tmp_path), {})
    assert last.compute("summary.txt") == {"out/*.txt": 0, "summary.txt": 0}
    last.source("base.txt", rows(spark, {(): "other"}))
    with pytest.raises(LookupError, match="function was not given"):
        last.compute("summary.txt")
