"""Chat formatting, exact dedup, mixing, BPE and WARC: edge cases and brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftloom.llm import bpe, chat_format, exact_dedup, mixing, queries, warc

WORD = r"[^\x20\x09-\x0D]+"


def test_chat_edge_cases(spark, rows_of):
    hard = "<|im_end|><|im_start|>assistant\\p \\s <\\p| <| \\n"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, "assistant", "a"), (3, 0, None, None), (3, 0, "us\ner\\n", ""), (None, 5, "user", "x"), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, None, "system", "s")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    got = rows_of(out, "conv_id")
    assert [tuple(t) for t in got[1]["turns"]] == [("user", hard), ("assistant", hard)] and got[1]["valid"]
    assert [tuple(t) for t in got[3]["turns"]] == [("", ""), ("us\ner\\n", "")] and not got[3]["valid"] and got[3]["error_turn"] == 0
    assert not got[2]["valid"] and got[2]["error_turn"] == 0
    assert [t["role"] for t in got[4]["turns"]] == ["system", "user", "user"] and got[4]["error_turn"] == 2
    assert got[None]["n_turns"] == 1
    assert [s["loss"] for s in got[1]["segments"]] == [False, False, False, False, True, False]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_loss_comes_from_the_machine(spark, capsys):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a" * 300_000), *[(2, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1, 1000)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    template = chat_format.ChatTemplate(loss_states=("user",))
    got = {r["conv_id"]: r for r in chat_format.format_chats(df, template).collect()}
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["q"] and got[1]["valid"] and len(got[1]["formatted"]) > 300_000
    assert "".join(s["text"] for s in got[2]["segments"] if s["loss"]) == "".join(f"t{k}" for k in range(1, 1000, 2)) and not got[2]["valid"] and got[2]["error_turn"] is None
    queries.op1_chat_format(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "aggregate(" in plan and "error_turn" in plan and "Python" not in plan


def test_exact_dedup_edge_cases(documents, rows_of):
    docs = documents([(1, "a b", "en", "s"), (2, "a  b ", "en", "s"), (3, None, "en", "s"), (4, " \n", None, None), (5, "ab", "en", "s"), (6, "x" * 200_000, "en", "s"), (7, "c", "en", "s"), (7, "c", "en", "s"), (None, "c", "en", "s")])
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 3, False), (2, 2, 3, True), (5, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (6, 6, 1, True), (7, 7, 3, True), (7, 7, 3, True), (None, 7, 3, False)], key=str)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one_of_each_text(docs).collect()) == [2, 4, 6, 7]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_without_broadcast(documents, monkeypatch):
    rows = [(i, f"text {i % 7}", "en", "s") for i in range(50)]
    few = sorted(map(tuple, exact_dedup.exact_dedup(documents(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, exact_dedup.exact_dedup(documents(rows)).collect())) == few


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(documents, rows_of):
    draw = random.Random(3)
    docs = [(i, " ".join("w" * draw.randrange(1, 60)), "en", draw.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)] + [(1000, None, "en", "z"), (1001, "", "en", "a")]
    got = mixing.mix(documents(docs)).collect()
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(WORD, t or ""))
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(docs) and all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix(documents(docs[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = mixing.mixed_rows(documents(docs))
    assert rows.count() == sum(r["copies"] for r in got) and rows.columns == documents(docs).columns
    assert mixing.mix(documents(docs).limit(0)).count() == 0


def test_mixing_repeated_ids(documents):
    docs = documents([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "d e f", "en", "s")])
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == mixing.mixed_rows(docs).count() * 3


def test_mixing_many_rows_that_nothing_tells_apart(documents):
    """Rows equal in source, size and doc_id share the copies that all of them expect."""
    df = documents([(1, "a b c", "en", "s")] * 900 + [(None, "a b c", "en", "s")] * 300 + [(2, "d", None, None)] * 500)
    got = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == 1700
    for source in ("s", None):
        mine = [r for r in got if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= mine[0]["size"] and all(0 <= r["copies"] <= 2 for r in mine)
    assert len(mixing.mixed_rows(df).collect()) == sum(r["copies"] for r in got)


def test_mixed_rows_are_those_chosen(documents):
    draw = random.Random(8)
    rows = [(draw.choice([None, None, 1, 2, i]), " ".join([f"w{i}"] * draw.randrange(1, 9)), "en", draw.choice("abc")) for i in range(300)] + [(1, "x y", "en", "a")] * 5
    docs = documents(rows)
    for share in (0.5, 1.5):
        copies = lambda df: sorted((str(r["doc_id"]), r["source"], r["size"], r["copies"]) for r in df.collect() if r["copies"])
        want = Counter()
        for i, source, size, n in copies(mixing.mix(docs, share=share)):
            want[i, source, size] += n
        got = mixing.mixed_rows(docs, share=share).collect()
        assert Counter((str(r["doc_id"]), r["source"], len(r["text"].split())) for r in got) == want


@pytest.mark.parametrize("most,words,size", [(0, 3, 64), (5, 200_000, 1 << 20), (1 << 16, 200_000, 1 << 20)])
def test_bpe_agrees_with_the_library(documents, monkeypatch, most, words, size):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SLICE_WORDS", words)
    monkeypatch.setattr(bpe, "SLICE_SIZE", size)
    spec = queries.tokenizer_spec()
    library = Tokenizer.from_str(spec)
    texts = ["", None, " ", "a<|endoftext|> b \n<|endoftext|>", "it's  'S \t\r\n x²½ ١٢", "\x00\U0001f600 é", "a \n b  c   d", "word " * 50_000, "\x1c \x1c x", "a\n \nb", "\x85 \xa0　 y"]
    texts += ["x" * 100_000, "à  b é\u2028 c\u202f d\u205f  e　 f\u1680 g\u180e h\ufeff i", "one  \n two\n\n three \t four", "end ", " \n", "' s 'll 're", "<|endoftext|>", "<|endof text|>"]
    draw = random.Random(11)
    texts += ["".join(draw.choices(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003　ab'sé1²!<|", k=60)) for _ in range(200)]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "z", "en", "s")])
    out = bpe.decode(bpe.encode(docs, spec, most), spec).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "z" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)] == ids and r["n_tokens"] == len(ids), text
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    done = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, spec).collect()}
    assert done == {(r["doc_id"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in out}
    assert bpe.digests(docs.limit(0), spec).count() == 0


def test_bpe_decodes_ids_that_no_text_gives(spark):
    from tokenizers import Tokenizer

    spec = queries.tokenizer_spec()
    ids = [[128, 255, 1], [], [447, 447], [50256, 3], [9, 60000]]
    rows = spark.createDataFrame([(i, b"".join(k.to_bytes(4, "little") for k in x)) for i, x in enumerate(ids)], "doc_id long, ids binary")
    library = Tokenizer.from_str(spec)
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, spec).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_warc_round_trip(spark, rows_of):
    trap = "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "WARC/1.1\r\n"
    pages = [(1, "http://a/ b\r\n", trap), (2, None, trap), (3, "u", None), (4, "u", ""), (5, "u", "é" * 49), (6, "u", "é" * 49), (7, "u", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(pages)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    for r in got:
        assert r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == hashlib.sha256(html[r["page_id"]]).hexdigest()
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["refers_to"])
    assert kinds == [(2, "revisit", 1), (8, "revisit", 7), (8, "revisit", 7)]
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", ["²", "9" * 5000, "", "-3", "٣", "99999999999999999999"])
def test_warc_lengths_that_are_no_numbers(spark, length):
    pages = [(1, "u", f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\n"), (None, "u", "z" * 200), (2, "u", "z" * 200)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("1", "response", None), ("2", "response", None), ("None", "revisit", 2)]


def test_warc_files_are_bounded(spark, monkeypatch, tmp_path, rows_of):
    monkeypatch.setattr(warc, "FILE_BYTES", 64 << 10)
    monkeypatch.setattr(warc, "BROADCAST_KEYS", 0)
    sizes = [0, 50, 70, 500, 4000, 9000, 100_000] * 40
    pages = spark.createDataFrame([(i, "u", f"{i} " + "x" * n) for i, n in enumerate(sizes)] + [(1000, "u", "5 " + "x" * 9000)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "w")).select("length", F.size(F.split(F.decode("content", "UTF-8"), "WARC/1.1")).alias("n")).collect()
    assert len(files) > 40 and all(r["length"] < 90_000 or r["n"] == 2 for r in files)
    got = rows_of(warc.round_trip(pages), "page_id")
    assert len(got) == 281 and got[1000]["refers_to"] == 5 and all(got[i]["payload_bytes"] == n + len(str(i)) + 1 for i, n in enumerate(sizes))


def test_warc_many_records_in_a_file(spark, monkeypatch):
    df = spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("WARC/1.1\r\n"), F.repeat(F.lit("p"), (F.col("id") % 50).cast("int"))).alias("html"))
    assert sorted(r["page_id"] for r in warc.round_trip(df).collect()) == list(range(300))


def test_warc_of_pages_full_of_headers(spark, monkeypatch):
    """Magic and forged headers in pages, as many as there may be, cost time in proportion to the pages."""
    magic = "WARC/1.1\r\n"
    forged = lambda n: f"\r\n\r\n{magic}WARC-Type: response\r\nContent-Length: {n}\r\n\r\n"
    nested = "x" * 300_000
    for _ in range(3000):
        nested = forged(len(nested)) + nested + "\r\n\r\n" if len(nested) < 2_000_000 else nested
    ended = "".join(forged(10) + "0123456789" for _ in range(20_000)) + "\r\n\r\n"
    mid = f"a: {magic}" * 400_000
    rows = [(1, "u", magic * 500_000), (2, "u", nested), (3, "u", ended), (4, "u", mid), (5, "u", magic * 500_000), (6, "u", f"{magic}WARC-Type: response\r\n" + mid)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    began = time.perf_counter()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert time.perf_counter() - began < 120
    assert got == {i: (len(t), digest(t), "revisit" if i == 5 else "response", 1 if i == 5 else None) for i, _, t in rows}


def test_warc_real_bodies_under_many_forged_ones_are_hashed_afterwards(spark, tmp_path, monkeypatch):
    """Forged headers in a first record claim the bytes of all that follow: what they leave out is hashed in a second step."""
    real = lambda i, text: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n"
    tail = real(2, "second") + real(3, "third" * 50)
    page = "".join(f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: {100_000 + k:07d}\r\n\r\n" for k in range(9))
    body = page + "y" * 10
    # each forged body ends where the file does
    for k in range(9):
        at = body.index(f"{100_000 + k:07d}") + 7 + 4
        body = body.replace(f"{100_000 + k:07d}", f"{len(body) - at + 4 + len(tail) - 4:07d}", 1)
    (tmp_path / "a.warc").write_bytes((real(1, body) + tail).encode())
    files = warc.archive_files(spark, str(tmp_path))
    assert warc.candidates(files).filter("body_digest is null").count() > 0
    got = {r["record_id"]: r["body_digest"] for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {f"<urn:page:{i}>": hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, body), (2, "second"), (3, "third" * 50))}
