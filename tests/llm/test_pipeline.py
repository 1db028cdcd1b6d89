"""The corpus pipeline against a plain version of each stage."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from driftloom.llm import mixing, queries

from .test_similarity_operators import near_copies, reached, shingles
from .test_text_operators import WORD, plain_targets


def plainly(rows):
    from tokenizers import Tokenizer

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for i, t, _, _ in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    rows = [r for r in rows if r[0] in first.values()]
    sets = {r[0]: shingles(r[1]) for r in rows}
    near = {i: {j for j in sets if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0} for i in sets}
    stays = set(reached(sets, near).values())
    rows = [r for r in rows if r[0] in stays]
    size = {r[0]: len(re.findall(WORD, r[1])) for r in rows}
    of = {}
    for r in rows:
        of.setdefault(r[3], []).append(r)
    words = {s: sum(size[r[0]] for r in rs) for s, rs in of.items()}
    targets, taken = plain_targets(words), []
    for s, rs in of.items():
        rate = targets[s] / words[s]
        rs.sort(key=lambda r: (size[r[0]], r[0]))
        copies = lambda u, n=len(rs), rate=rate: [math.floor(u + k * rate) - math.floor(u + (k - 1) * rate) for k in range(1, n + 1)]
        taken += [r for c, r in zip(copies(mixing.offset()), rs) for _ in range(c)]
    library, out = Tokenizer.from_str(queries.tokenizer_spec()), Counter()
    for i, t, _, _ in taken:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out[i, len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha(library.decode(ids, skip_special_tokens=False).encode())] += 1
    return out


def test_run_against_a_plain_version(spark, documents, tmp_path):
    draw = random.Random(2)
    texts = near_copies(n=40)
    rows = [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(1000, "12 34 !", "en", "a"), (1001, "!", "en", "b"), (1002, texts[0] + " \n", "en", "a"), (1003, "eins zwei drei vier", "de", "c")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plainly(rows)


def test_stages_keep_the_columns_of_documents(spark, documents, tmp_path):
    docs = documents([(1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "a")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_dedup_stages_go_by_row(spark, documents, tmp_path):
    long = [f"w{k}" for k in range(60)]
    near = [" ".join(long), " ".join(long[:-1]), " ".join(long[1:])]
    rows = [(7, "c d", "en", "a"), (7, "c d", "en", "b"), (None, "c d", "en", "a"), (7, "e", "en", "a"), (8, "e ", "en", "a"), (None, "f", "en", "a"), (None, " f", "en", "a"), (None, "", "en", "a"), (None, None, "en", "a")]
    stage = dict(corpus_pipeline.STAGES)
    got = stage["exact dedup"](spark, documents(rows), str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == [("7", "c d"), ("8", "e "), ("None", ""), ("None", " f")]
    rows = [(5, near[0], "en", "a"), (5, near[0], "en", "b"), (5, near[1], "en", "a"), (None, near[2], "en", "a"), (5, "other", "en", "a"), (None, "g h", "en", "a"), (None, "g h", "en", "b")]
    got = stage["n-gram Jaccard join"](spark, documents(rows), str(tmp_path)).collect()
    texts = [r["text"] for r in got]
    assert len(texts) == 3 and {"other", "g h"} < set(texts) and [r["doc_id"] for r in got if r["text"] in near] == [5]


def test_language_stage_keeps_texts_of_an_unlabelled_corpus(spark, documents, tmp_path):
    docs = documents([(1, "one two", None, "a"), (2, "12 !", None, "a"), (None, "drei", None, "b"), (4, None, None, "b"), (5, "", None, None)])
    got = corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()
    assert sorted(r["text"] for r in got) == ["drei", "one two"]
