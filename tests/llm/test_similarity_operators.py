"""N-gram join, embedding dedup and substring dedup against brute force, with hot groups and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import common, embedding_dedup, links, ngram_join, queries, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WORD, text or "")


def shingles(text):
    w = tuple(words_of(text))
    return {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def reached(ids, linked):
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo = [i]
            out[i] = i
            while todo:
                for j in linked[todo.pop()]:
                    if j not in out:
                        out[j] = i
                        todo.append(j)
    return out


def near_copies(seed=1, n=150):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = draw.choices(vocabulary, k=60)
    base = draw.choices(vocabulary, k=150)
    docs = []
    for i in range(n):  # one large group of near copies
        w = list(base)
        for _ in range(draw.randrange(0, 5)):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        docs.append(" ".join(w))
    for i in range(n):  # a passage that all share
        docs.append(" ".join(draw.choices(vocabulary, k=draw.randrange(5, 200)) + passage))
    docs += [docs[n], docs[n] + " ", None, "", "  ", "one", "one two three", "one\ttwo\nthree", "x " * 5000]
    return docs


@pytest.mark.parametrize("leaf,block", [(64, 192), (8, 16)])
def test_ngram_join(documents, monkeypatch, leaf, block):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(links, "BLOCK", block)
    texts = near_copies()
    got = {r["doc_id"]: r for r in ngram_join.near_classes(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    sets = [shingles(t) for t in texts]
    linked = {i: {j for j in range(len(texts)) if i != j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0)} for i in range(len(texts))}
    want = reached(range(len(texts)), linked)
    assert {i: r["class_id"] for i, r in got.items()} == want
    lost = sum(len(linked[i]) - r["n_links"] for i, r in got.items())
    assert 0 <= lost <= 0.002 * sum(map(len, linked.values()))  # recall is promised, precision is exact
    assert {i for i, r in got.items() if r["kept"]} == set(want.values())


def test_ngram_join_edge_cases(documents):
    docs = documents([(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (None, "q", "en", "s"), (2, "z", "en", "s")])
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in ngram_join.near_classes(docs).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "2", 0), ("None", "1", 2), ("None", "None", 0)]
    assert ngram_join.near_classes(docs.limit(0)).count() == 0


def test_ngram_join_keeps_its_recall_on_split_paths(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    draw = random.Random(6)
    passages = [[[f"s{slot}_{v}_{k}" for k in range(8)] for v in range(3)] for slot in range(10)]
    texts, made_of = [], Counter()
    for i in range(1500):  # a third of the texts has each passage, so that paths are split up to three times
        chosen = [draw.randrange(3) for _ in passages]
        made_of[tuple(chosen)] += 2
        words = [w for slot, v in zip(passages, chosen) for w in slot[v]]
        texts += [" ".join(words + [f"t{i}_{half}_{k}" for k in range(9)]) for half in range(2)]
    true = sum(n * (n - 1) // 2 for n in made_of.values())  # J = 76 / 94 with the same passages, 64 / 106 at most else
    got = ngram_join.near_classes(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert 0.999 * true <= sum(r["n_links"] for r in got) / 2 <= true  # with 8 runs for all, 4 of the first 1500 are lost


def test_ngram_join_without_ids(documents):
    text = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(text)), (None, " ".join(text[:-1])), (None, "q r s"), (7, " ".join(text[1:])), (7, "another text"), (7, " ".join(text[1:-1]))]
    got = ngram_join.near_classes(documents([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == [("7", "7", 0), ("7", "7", 3), ("7", "7", 3), ("None", "7", 3), ("None", "7", 3), ("None", "None", 0)]


def test_runs_follow_from_the_target_recall():
    assert (ngram_join.runs_for(2), ngram_join.runs_for(4)) == (8, 15)
    for recall in (0.9, 0.99, 0.999, 0.99999):
        assert (1 - 0.8**4) ** ngram_join.runs_for(4, recall) <= (1 - recall) / 2


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 32))
    x[100:300] = x[0] + 0.15 * rng.standard_normal((200, 32))  # one large group
    x[300:340] = x[1]
    x[340:400] = x[2:62] * 3 + 0.2 * rng.standard_normal((60, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] + [1.0] * 31), (1004, [None] + [1.0] * 31), (1005, [float("inf")] + [1.0] * 31), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + bad], "vec_id long, embedding array<double>, node string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    linked = {i: set(np.flatnonzero(near[i])) - {i} for i in range(600)} | {i: set() for i, _ in bad} | {1006: {1007}, 1007: {1006}}
    want = reached(linked, linked)
    assert len(got) == len(linked) and {i: r["component_id"] for i, r in got.items()} == want
    found, true = sum(r["n_links"] for r in got.values()), sum(map(len, linked.values()))
    assert 0.998 * true <= found <= true and all(r["n_links"] <= len(linked[i]) for i, r in got.items())
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_dedup_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.1]), (None, [0.0, 1.0]), (3, [0.0, -0.0]), (None, None), (4, [3.0, 0.0]), (5, [1.0, 0.0, 0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, kept int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("1", 3, "1", True), ("1", 3, "1", True), ("3", 0, "3", True), ("4", 3, "1", False), ("5", 0, "5", True), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 3, "1", False),
    ]


@pytest.mark.parametrize("n", [5, 7])
def test_embedding_recall_with_more_lines(spark, monkeypatch, n):
    """The plans of larger tables, on a fixture: cells of several lines lose no more than they promise."""
    sizes = iter(range(10**5, 10**9, 10**5))
    large = next(k for k in sizes if embedding_dedup.plan(k)[0] >= n) if embedding_dedup.plan(10**5)[0] < n else next(k for k in range(400, 10**5, 400) if embedding_dedup.plan(k)[0] >= n)
    lines, tables = embedding_dedup.plan(large)
    monkeypatch.setattr(embedding_dedup, "plan", lambda *_: (lines, tables))
    rng = np.random.default_rng(n)
    x = rng.standard_normal((700, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.standard_normal((700, 48))
    step -= (step * x).sum(axis=1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    y = 0.9505 * x + math.sqrt(1 - 0.9505**2) * step  # each just above the threshold
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    found = sum(r["n_links"] for r in embedding_dedup.near_vectors(df).collect()) / 2
    assert lines >= n and 0.99 * 700 <= found <= 700


def test_ngram_join_beyond_its_broadcasts(documents, monkeypatch):
    texts = near_copies(seed=4, n=30)
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    want = sorted(map(tuple, ngram_join.near_classes(docs).collect()))
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, ngram_join.near_classes(docs).collect())) == want
    kept = sorted(map(str, ngram_join.keep_one_of_each_class(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert sorted(map(str, ngram_join.keep_one_of_each_class(docs).collect())) == kept and len(kept) == sum(r[3] for r in want)
    some = documents([(1, "a", "en", "s"), (None, "b", "en", "s"), (2, "c", "en", "s")])
    ids = some.filter("doc_id = 1 or doc_id is null").select("doc_id")
    assert [r["text"] for r in common.with_ids(some, "doc_id", ids).collect()] == ["a"]
    assert sorted(r["text"] for r in common.without_ids(some, "doc_id", ids).collect()) == ["b", "c"]


def test_plan_keeps_its_promise():
    for n in (10, 10_000, 10_000_000):
        lines, tables = embedding_dedup.plan(n)
        assert 1 <= lines <= embedding_dedup.MOST_LINES and tables < 60
    p = 0.9544997
    assert sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(embedding_dedup.LEAST)) < 2e-4


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = tuple(words_of(t))
        for k in range(len(w) - 49):
            first[w[k : k + 50]] = min(first.get(w[k : k + 50], math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = tuple(words_of(t))
        gone = {p for k in range(len(w) - 49) if first[w[k : k + 50]] < (math.inf if i is None else i) for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(documents):
    draw = random.Random(9)
    vocabulary = [f"é{k}" for k in range(400)]
    passages = [draw.choices(vocabulary, k=n) for n in (30, 49, 50, 51, 75, 120, 300)] + [["a"] * 120, ["a", "b"] * 60]
    rows = []
    for i in range(160):
        w = []
        for _ in range(draw.randrange(0, 4)):
            p = draw.choice(passages)
            a = draw.randrange(0, max(1, len(p) // 3))
            w += draw.choices(vocabulary, k=draw.randrange(0, 40)) + p[a : len(p) - draw.randrange(0, 5)]
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500 + i, rows[3][1] + " tail") for i in range(20)] + [(700 + i, rows[5][1]) for i in range(20)]
    rows += [(3, rows[7][1]), (3, rows[3][1]), (None, rows[5][1]), (None, rows[8][1] + " x"), (900, None), (901, ""), (902, "w " * 30_000), (903, "w " * 20_000)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(documents([(i, t, "en", "s") for i, t in rows])).collect())
    assert got == brute_substrings(rows)
    assert substring_dedup.remove_repeats(documents([(1, "a", "en", "s")]).limit(0)).count() == 0


def test_rows_without_an_id_are_told_apart(documents):
    """Whatever their number, each meets its own spans only; what one of them shares with an earlier document costs no other a word."""
    rng = random.Random(5)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    rows = [(1, texts[0]), (None, texts[0]), *((None, t) for t in texts[1:]), (2, texts[5] + " more"), (7, texts[6][:-3]), (7, texts[6])]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(documents([(i, t, "en", "s") for i, t in rows])).collect())
    assert got == brute_substrings(rows) and [x[2] for x in got if x[0] == "None"].count(0) == 77
    numbered = substring_dedup.numbered(documents([(i, t, "en", "s") for i, t in rows]))
    spans = numbered.select("row", F.lit(0).alias("start"), F.lit(55).alias("end")).filter("doc is not null")
    assert substring_dedup.at_source(numbered, spans).groupBy("row").count().filter("count > 11").isEmpty()


def test_paths_are_verified_at_the_source(documents):
    """A span that the graph takes for a path elsewhere too counts only where its words are the same."""
    w = [f"v{k}" for k in range(70)]
    texts = {1: w, 2: w, 3: [*w[:40], "other", *w[41:]]}
    rows = documents([(i, " \n".join(t), "en", "s") for i, t in texts.items()])
    rows = substring_dedup.numbered(rows)
    spans = rows.sparkSession.createDataFrame([(r["row"], 5, 65) for r in rows.collect()], "row long, start long, end long")
    read = [r for r in substring_dedup.at_source(rows, spans).collect() if r["size"] == 60]
    hashes = {r["doc"]: r["hash"] for r in read}
    assert len(read) == 3 and hashes[1] == hashes[2] != hashes[3]
    want = int.from_bytes(hashlib.blake2b(" ".join(w[5:65]).encode(), digest_size=8).digest(), "little", signed=True)
    assert hashes[1] == want


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
