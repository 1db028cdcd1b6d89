import hashlib
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions import commands, fingerprints, paths


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_side_file_names(spark):
    names = [("source/", "source"), ("a/b.txt", "a/b.txt"), ("source/*.csv", "source/vector.csv"), ("source/*/", "source/vector"), ("source/*/data/*/*.csv", "source/vector-data-vector-vector.csv"), ("*/", "vector")]
    assert values(spark, [(n,) for n, _ in names], "p string", paths.side_stem(F.col("p"))) == [x for _, x in names]
    assert values(spark, [("a/*.txt",)], "p string", paths.metadata_file(F.col("p"))) == ["a/vector.txt.prov.json"]


def test_index_functions(spark):
    rows = [("d/*/*.txt", ["a", "b"]), ("d/*/*.txt", ["a"]), ("d/x.txt", ["a"]), ("*/*", ["*", "b"]), ("d/*", [])]
    assert values(spark, rows, "p string, i array<string>", paths.apply_index(F.col("p"), F.col("i"))) == ["d/a/b.txt", "d/a/*.txt", "d/x.txt", "*/b", "d/*"]
    assert values(spark, rows, "p string, i array<string>", paths.rank(F.col("p"))) == [2, 2, 0, 2, 1]
    assert values(spark, rows[:2], "p string, i array<string>", paths.truncate_index(F.col("i"), 1)) == [["a"], ["a"]]
    with pytest.raises(Exception, match="fewer parts"):
        values(spark, rows[4:], "p string, i array<string>", paths.truncate_index(F.col("i"), 1))
    assert values(spark, [("test6.txt.gz",), ("a.b.txt",)], "n string", paths.first_dot_stem(F.col("n"))) == ["test6", "a"]


def test_relative_paths(spark):
    rows = [("a/m.json", "a/x.txt"), ("a/b/m.json", "a/x/"), ("m.json", "d/x")]
    relative, resolved = paths.relative_path(F.col("b"), F.col("t")), paths.resolved_id(F.col("b"), F.col("t"))
    assert values(spark, rows, "b string, t string", relative) == ["x.txt", "../x/", "d/x"]
    back = [("a/m.json", "x.txt"), ("a/b/m.json", "../x/"), ("m.json", "d/x")]
    assert values(spark, back, "b string, t string", resolved) == [t for _, t in rows]
    assert values(spark, [(None, "x"), ("x", None)], "b string, t string", relative) == [None, None] == values(spark, [(None, "x"), ("x", None)], "b string, t string", resolved)
    for bad in (("../a/m", "x"), ("/a/m", "x"), ("a/m", "/x")):
        with pytest.raises(Exception, match="no way from"):
            values(spark, [bad], "b string, t string", relative)


def test_relative_paths_are_those_of_the_library(spark):
    rng = random.Random(8)
    parts = ["a", "b", "c.txt", ".", "..", ""]
    some = lambda: "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
    pairs = [(lead + some(), lead + some()) for lead in ("/", "") for _ in range(400)]
    pairs = [(b, t) for b, t in pairs if b and t and not posixpath.normpath(posixpath.dirname(b) or ".").startswith("..") and b.startswith("/") == t.startswith("/") and not b.startswith("//") and not t.startswith("//")]
    keep = lambda out, t: out + "/" if t.endswith("/") and not out.endswith("/") else out
    got = values(spark, pairs, "b string, t string", paths.relative_path(F.col("b"), F.col("t")))
    root = lambda p: p if p.startswith("/") else f"/deep/er/and/deeper/still/{p}"
    assert len(pairs) > 300 and got == [keep(posixpath.relpath(root(t), root(posixpath.dirname(b))), t) for b, t in pairs]
    got = values(spark, pairs, "b string, t string", paths.resolved_id(F.col("b"), F.col("t")))
    assert got == [keep(posixpath.normpath(posixpath.join(posixpath.dirname(b), t)), t) for b, t in pairs]


def test_commands(spark):
    line = "merge --left=$in3 $in1 $in3 -o $out7,$out2"
    rows = [(line, 3, 7), (line, 2, 7), (line, 3, 6), ("$in0", 1, 1), ("none", 0, 0)]
    assert values(spark, rows, "c string, i int, o int", commands.valid(F.col("c"), F.col("i"), F.col("o"))) == [True, False, False, False, True]
    assert values(spark, rows[:1], "c string, i int, o int", commands.references(F.col("c"), "in")) == [[1, 3]]
    assert values(spark, rows[:1], "c string, i int, o int", commands.checked(F.col("c"), F.col("i"), F.col("o"))) == [line]
    with pytest.raises(Exception, match="beyond the declared"):
        values(spark, rows[1:2], "c string, i int, o int", commands.checked(F.col("c"), F.col("i"), F.col("o")))
    paths_ = ["p$out1", "q", None, *"defghijk", "twelfth"]
    schema, filled = "c string, i array<string>, o array<string>", commands.substitute(F.col("c"), F.col("i"), F.col("o"))
    cases = [("x '$in1' $$in2|$in12$in1 > $out1", "x 'p$out1' $q|twelfthp$out1 > z"), ("", ""), ("plain", "plain"), (None, None), ("$out1", "z"), ("$in", "$in")]
    assert values(spark, [(c, paths_, ["z"]) for c, _ in cases], schema, filled) == [w for _, w in cases]
    for bad in ("run $in0", "run $in13", "run $out2", "run $in99999999999"):
        with pytest.raises(Exception, match="no input or output"):
            values(spark, [(bad, paths_, ["z"])], schema, filled)


def test_command_lines(spark):
    cases = {
        "sort -u file": ("sort", "-u file"), "\t sort \n": ("sort", ""), 'sort  "a b"  c ': ("sort", '"a b"  c'), '"my sort" "x"  y': ('"my sort"', '"x"  y'),
        '"open sort x': ('"open sort x', ""), '"only"': ('"only"', ""), '"': ('"', ""), '""': ('""', ""), '"a"b': ('"a"', "b"), "": ("", ""),
    }
    rows = [(c,) for c in cases]
    assert list(zip(values(spark, rows, "c string", commands.program(F.col("c"))), values(spark, rows, "c string", commands.arguments(F.col("c"))), strict=True)) == list(cases.values())


def test_full_paths_and_short_versions(spark):
    rows = [("/r", "a/b"), ("/r/", "a/"), ("s3://x/r", "c")]
    assert values(spark, rows, "r string, i string", paths.full_path(F.col("r"), F.col("i"))) == ["/r/a/b", "/r/a/", "s3://x/r/c"]
    with pytest.raises(Exception, match="relative root"):
        values(spark, [("r", "a")], "r string, i string", paths.full_path(F.col("r"), F.col("i")))
    with pytest.raises(Exception, match="ends with"):
        values(spark, [("/r", "a")], "r string, i string", paths.metadata_full_path(F.col("r"), F.col("i")))
    with pytest.raises(Exception, match="an absolute path"):
        values(spark, [("/r/", "/a")], "r string, i string", paths.below(F.col("r"), F.col("i")))
    assert values(spark, [('{"format": 1}',), ("{}",), ('{"format": "x"}',), ("no json",)], "d string", paths.format_number(F.col("d"))) == [1, None, None, None]
    assert values(spark, [("ABCDEF0123",)], "v string", fingerprints.short_version(F.col("v"))) == ["abcdef01"]


def test_directory_digests(spark):
    sha = lambda b: hashlib.sha512(b).digest()
    files = {"r/d/b.txt": b"2", "r/d/a.txt": b"1", "r/d/.h": b"x", "r/d/a.hash": b"y", "r/d/s/z": b"3", "r/q": b"4"}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    got = {r["path"]: r["version"] for r in fingerprints.merkle_tree(df.select("path", fingerprints.version(F.col("content")).alias("version"))).collect()}
    s = sha(b"z" + sha(b"3"))
    d = sha(b"a.txtb.txts" + sha(b"1") + sha(b"2") + s)
    r = sha(b"qd" + sha(b"4") + d)
    assert got == {"r/d/s/": s.hex().upper(), "r/d/": d.hex().upper(), "r/": r.hex().upper()}


@pytest.mark.parametrize("batch", [3, 10000])
def test_a_parent_of_many_children_is_a_stream(spark, batch):
    """One parent holds half of all children; runs cross the ends of batches; nulls among keys, names and digests."""
    rows = [("big" if i % 2 else f"p{i % 7}", i % 3, f"{i * 7919 % 1000:03d}é", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(200)]
    rows += [(None, 1, "x", None), (None, 1, None, "AB" * 32), ("none", None, None, None), ("big", 1, "000", "CD" * 32)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = fingerprints.merkle(spark.createDataFrame(rows, "a string, b int, name string, v string"), ["a", "b"], "name", "v", 256).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2] is not None, (r[2] or "").encode()))
        raw = "".join(r[2] or "" for r in mine).encode() + b"".join(bytes.fromhex(r[3] or "") for r in mine)
        want[key] = (len(mine), hashlib.sha256(raw).hexdigest().upper())
    assert {(r["a"], r["b"]): (r["n"], r["version"]) for r in got} == want and len(got) == len(want)
    assert fingerprints.merkle(spark.createDataFrame([], "a string, name string, v string"), ["a"], "name", "v").count() == 0
