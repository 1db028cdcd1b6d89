"""Columns of the input that are called like the operators' own: they are neither read nor returned, or returned as they were."""

import pytest
from pyspark.sql import functions as F

from driftloom.llm import bpe, collocations, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, quality, substring_dedup, toxicity, vector_codes
from driftloom.llm.queries import tokenizer_spec

NAMES = ["row_", "row", "copies_", "picked_", "picked", "id_", "ID__", "rep_", "node", "label", "toxic", "quality", "size", "rank", "piece", "doc", "sequence", "words", "phrase", "code", "held_out", "kept", "length", "prefix", "first_", "n", "s", "p", "t", "e"]


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[i * 3 : i * 3 + 70]) for i in range(20)] + [" ".join(words[:70]), " ".join(words[:70]) + " more", None, "", "x y"]
    rows = spark.createDataFrame([(i if i != 9 else None, t, ["en", "de", None][i % 3], ["a", "b"][i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return rows.withColumns({name: F.lit("clash") if i % 2 else F.lit(0).cast("long") for i, name in enumerate(NAMES)})


def plain(df):
    return df.select("doc_id", "text", "lang", "source")


def same(docs, operator):
    rows = lambda df: sorted(map(str, operator(df).collect()))
    assert rows(docs) == rows(plain(docs))


def test_operators_don_t_read_them(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x", "y") for i in range(20)], "doc_id long, toxic int, quality int, text string, label string")
    for operator in (
        exact_dedup.exact_dedup,
        ngram_join.near_classes,
        lambda df: toxicity.score_toxicity(df, labels),
        lambda df: mixing.mix(df).drop("source"),
        language_id.identify,
        substring_dedup.remove_repeats,
        lambda df: collocations.collocations(df, least=3),
        lambda df: quality.score_quality(df, labels),
        lambda df: bpe.digests(df, tokenizer_spec()),
    ):
        same(docs, operator)


def test_stages_return_them_as_they_were(docs):
    for stage in (exact_dedup.keep_one_of_each_text, ngram_join.keep_one_of_each_class, mixing.mixed_rows, language_id.keep_identified):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert sorted(map(str, plain(out).collect())) == sorted(map(str, stage(plain(docs)).collect()))
        assert out.select([c for c in docs.columns if c in NAMES]).distinct().count() == 1


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0] * 8, i % 2) for i in range(30)], "vec_id long, embedding array<float>, label int")
    wide = rows.withColumns({name: F.lit("clash") for name in [*NAMES, "ints", "changed", "before", "of", "error"] if name != "label"})
    for operator in (vector_codes.code_digests, embedding_dedup.near_vectors):
        assert sorted(map(str, operator(wide).collect())) == sorted(map(str, operator(rows).collect()))
