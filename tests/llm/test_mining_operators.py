"""Collocations, quality and vector codes against plain versions, on small tables with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import collocations, quality, vector_codes


def plain_collocations(docs, least, top, percent):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if all(100 * b < percent * a for b in longer):
            score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def mined(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("buffer", [collocations.BUFFER, 50])
def test_collocations_are_those_of_brute_force(spark, documents, monkeypatch, buffer):
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    rng = random.Random(11)
    words = ["New", "york", "Ä", "ÄB", "x", "of", "the", "'", "a|b", " ", "s\x1fp"]
    texts = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    texts += [("new york city hall " * 40, "en"), (None, "en"), ("", None), (" \t\n.,;", "fr"), ("one two" * 3, "en")] + [("big apple pie", "de")] * 40
    df = documents([(i % 50, t, lang, None) for i, (t, lang) in enumerate(texts)])
    for least, top, percent in ((5, 2000, 80), (30, 7, 80), (12, 100, 101)):
        assert mined(collocations.collocations(df, least, top, percent)) == plain_collocations(texts, least, top, percent)


def test_ties_are_in_order_of_bytes_and_nothing_frequent_is_lost_by_a_narrow_folded_sketch(spark, documents, monkeypatch):
    texts = [(f"w{i} v{i}. " * 30, "en") for i in range(300)] + [("é é. " * 30, "en"), ("z z. " * 30, "en")]
    df = documents([(i, t, lang, None) for i, (t, lang) in enumerate(texts)])
    monkeypatch.setattr(collocations, "CELL_BYTES", 1)  # 2 ** 17 cells, folded to one block of bits
    monkeypatch.setattr(collocations, "MOST_BITS", collocations.BLOCK_BITS)
    got = mined(collocations.collocations(df))
    assert got == plain_collocations(texts, 30, 2000, 80) and got["en", 1][0] == "w0 v0" and got["en", 302][0] == "é é"


def test_no_documents_no_collocations(spark, documents):
    assert collocations.collocations(documents([])).collect() == []
    assert collocations.collocations(documents([(1, None, None, None)])).collect() == []


def test_a_count_of_long_passes_64_bits_in_the_score(spark):
    counted = spark.createDataFrame([("en", "a", 1, 6 * 10**18), ("en", "b", 1, 5 * 10**18), ("en", "a b", 2, 4 * 10**18)], "lang string, phrase string, words int, f long")
    assert collocations.scored(counted).first()["score"] == 2_000_000 * 4 * 10**18 // (11 * 10**18)


def test_one_sketch_overestimates_and_separates(spark, documents):
    p = collocations.Phrases([b"a b a b. a b", b"c"], np.array([1, 2]))
    h, ok = p.ngrams(2)
    assert ok.tolist() == [True, True, True, False, True, False] and h[0] == h[2] == h[4] != h[1]
    assert p.phrases(np.array([0, 4]), 2) == [b"a b", b"a b"] and p.text.tolist() == [0] * 6 + [1]
    other, _ = collocations.Phrases([b"a b"], np.array([2])).ngrams(2)
    assert other[0] != h[0]  # of another language


@pytest.mark.parametrize("bits", [12, 14])
def test_steps_lead_to_the_cells(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 40, 3000):
        cell = np.unique(rng.integers(0, 1 << 16, n).astype(np.uint32))
        counts = rng.integers(1, 30, len(cell)).astype(np.uint8)
        block = cell >> bits
        begins = np.flatnonzero(np.diff(block, prepend=block[0] ^ 1))
        steps, spread, reps = collocations.stepped(cell, begins, counts, bits)
        ends = np.cumsum(np.add.reduceat(reps, begins))
        got = {}
        for b, low, high in zip(block[begins].tolist(), [0, *ends[:-1]], ends, strict=True):
            at = np.cumsum(steps[low:high], dtype=np.int64) - 1
            assert (np.diff(at) > 0).all() and at[-1] < 1 << bits
            got |= {(b << bits) + int(a): int(c) for a, c in zip(at, spread[low:high], strict=True) if c}
        assert got == dict(zip(cell.tolist(), counts.tolist(), strict=True)) and steps.min() > 0


# -- quality


def plain_features(text):
    """Words, pairs and n-grams by their characters, as a multiset."""
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text.lower())
    out = Counter(("word", w) for w in words)
    out.update(("again",) if a == b else ("pair", a, b) for a, b in zip(words, words[1:], strict=False))
    for w in words:
        edged = f" {w} "
        out.update(("gram", edged[i : i + k]) for k in quality.ORDERS for i in range(len(edged) - k + 1))
    return out


def test_features_of_quality_are_words_pairs_and_ngrams():
    texts = ["The the THE cat", "", "ab  cd\tab", "\n\x0b", "Ünï €€€€ " * 2000, "a"]
    for text, (index, n) in zip(texts, quality.counted(texts), strict=True):
        want = plain_features(text)
        assert n.sum() == sum(want.values()) and len(index) <= len(want)  # equal hashes meet
        if len(want) < 100:
            assert sorted(n) == sorted(want.values())
    alone, together = quality.counted(["cat sat"])[0], quality.counted(["x", "cat sat", "y z"])[1]
    assert (alone[0] == together[0]).all() and (alone[1] == together[1]).all()


def test_scores_of_texts_are_those_of_their_averaged_vectors(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)
    rng = np.random.default_rng(3)
    net = quality.Embeddings(rng)
    net.output, net.bias = rng.normal(size=(quality.WIDTH, 2)), np.array([0.1, 0.3])
    texts = ["good words here", "", "bad bad bad", "mixed Text, with marks!"]
    model = quality.Model(*net.by_feature())
    for text, (index, n), score in zip(texts, quality.counted(texts), model.scores(texts), strict=True):
        average = (n / max(1, n.sum())) @ net.vectors[index] if len(n) else np.zeros(quality.WIDTH)
        logits = average @ net.output + net.bias
        assert math.isclose(score, 1 / (1 + math.exp(logits[0] - logits[1])), rel_tol=1e-9), text


def test_a_step_goes_down_the_gradient():
    net = quality.Embeddings(np.random.default_rng(1))
    net.output = np.random.default_rng(2).normal(size=net.output.shape)
    e = quality.Example(1, np.array([3, 9]), np.array([0.25, 0.75]))

    def loss():
        return -np.log(quality.probabilities((e.weight @ net.vectors[e.index]) @ net.output + net.bias)[1])

    before, step, vector, at = loss(), 1e-6, net.vectors[9].copy(), net.output.copy()
    net.vectors[9, 0] += step
    slope = (loss() - before) / step
    net.vectors[9] = vector
    net.learn(e, 1e-3, 1.0)
    assert loss() < before and math.isclose((vector[0] - net.vectors[9, 0]) / 1e-3, slope, rel_tol=1e-3) and (net.output != at).any()


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score_quality(docs, labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) >= 0.97


def test_quality_of_awkward_rows(spark, documents):
    import zlib

    rows = [(i, f"good text number {i}" if i % 3 else "!!! $$$ %%%", None, None) for i in range(60)] + [(1, "again", "x", "y"), (None, "no id", None, None), (70, None, "en", None), (71, "", None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(60)] + [(1, None, "x"), (None, 1, "x"), (70, 1, "x"), (2, 0, "x")], "doc_id long, quality int, text string")
    out = quality.score_quality(documents(rows), labels).collect()
    assert len(out) == 64 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    by_id = {r["doc_id"]: r["score"] for r in out if r["doc_id"] not in (1, None)}
    assert by_id[70] == by_id[71] and by_id[2] > by_id[3]
    assert quality.score_quality(documents([]), labels).collect() == []
    assert [r["score"] for r in quality.score_quality(documents(rows[:2]), labels.limit(0)).collect()] == pytest.approx([0.0, 0.0])
    ones = labels.filter("quality = 1")
    assert {r["score"] for r in quality.score_quality(documents(rows), ones).collect()} == {1.0}


# -- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = [], Counter()
    for (i, _, label), v in zip(kept, cut, strict=True):
        best = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, ints int, changed int"


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], VECTORS)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.code_digests(df, **options).collect()), key=str)


def awkward_vectors(n):
    rng = random.Random(13)
    rows = [(rng.randrange(n) if i % 7 else i, [round(rng.gauss(0, 1), 2) for _ in range(16)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(3, [0.5] * 16, 1)] * 40  # copies
    rows += [(n + 1, None, 0), (n + 2, [1.0] * 15 + [None], 0), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("-inf")] + [0.0] * 15, 1), (None, [-0.3] * 16, None)]
    return rows


def test_codes_are_those_of_brute_force(spark):
    rows = awkward_vectors(150)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows[:9]) == plain_codes(rows[:9])  # fewer vectors than entries
    large = [(i, [x * 10_000 for x in v], label) for i, v, label in awkward_vectors(40) if v and all(x is not None and math.isfinite(x) for x in v)]
    assert coded(spark, large) == plain_codes(large)  # distances are taken in whole numbers of any size


def test_codes_with_other_parameters_and_joined_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    rows = awkward_vectors(60)
    assert coded(spark, rows, parts=4, entries=3, rounds=2) == plain_codes(rows, 4, 3, 2)


def test_only_changed_parts_contribute(spark):
    state = spark.createDataFrame(
        [([1, 2, 3, 4], bytes([0, 1]), bytes([0, 1]), 0), ([5, 6, 7, 8], bytes([255, 255]), bytes([1, 0]), 3), ([9, 9, 9, 9], bytes([0, 1]), bytes([1, 1]), 1)],
        "ints array<bigint>, before binary, code binary, changed long",
    )
    got = {tuple(r[:3]): int(r[3]) for r in vector_codes.contributions(state, 2, 255).collect()}
    assert got == {(0, 1, -1): 2, (0, 1, 0): 14, (0, 1, 1): 15, (1, 0, -1): 1, (1, 0, 0): 7, (1, 0, 1): 8, (0, 0, -1): -1, (0, 0, 0): -9, (0, 0, 1): -9}


def test_vectors_that_cannot_be_coded(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    for rows in ([(1, [1.0] * 15, 0)], [(1, [1.0] * 16, 0), (2, [1.0] * 8, 0)]):
        with pytest.raises(ValueError, match="one length"):
            coded(spark, rows)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e300] * 16, 0)])
