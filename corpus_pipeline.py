"""From raw documents to tokens: five stages, each an operator of driftloom.llm applied to what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A stage's result must have been written when the
next stage is called: what the stage wrote for itself is then deleted.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from driftloom.llm.common import delete_folder, run_folder, settle, small_batches, table
from driftloom.llm.queries import tokenizer_spec

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[tuple[str, str]] = []  # application and folder of stages that ran


def tidy(stage: Stage) -> Stage:
    """Intermediate tables of the stages before go; those of this one are kept together."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        here = spark.sparkContext.applicationId
        while _left:
            application, folder = _left.pop()
            if application == here:
                delete_folder(spark, folder)
        small_batches(spark)
        with run_folder(spark) as folder:
            _left.append((here, folder))
            return stage(spark, docs, sf_dir)

    return run_stage


@tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go."""
    return language_id.keep_identified(docs)


@tidy
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exact_dedup.keep_one_of_each_text(docs)


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a 5-word Jaccard similarity of 0.8 or more one stays."""
    return ngram_join.keep_one_of_each_class(docs)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


@tidy
def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, tokenizer_spec())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode_and_decode),
]

#: learnt models, near-duplicate classes and BPE are not SQL; tests/llm checks run() against a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
