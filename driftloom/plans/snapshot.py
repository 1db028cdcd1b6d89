"""A recorded snapshot of the documents, derived from the tables, to compare the present documents with.

The documents are the elements of a vector with index (lang, source, doc_id). Versions are SHA-256 here, which DuckDB has too.
What was recorded: all documents, except that rows labelled of low quality were never recorded and rows
labelled toxic were recorded with another text; and the benchmark items, which are gone from the documents.
What is stored: gone items of at least 200 code points, and labelled rows (toxic ones in ``azure1``, others in ``local``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import version
from ..sources.tables import table

INDEX = ["lang", "source", "doc_id"]
GONE = 1_000_000_000_000


def digest(text):
    return version(F.encode(text, "UTF-8"), 256)


def item(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(*INDEX, digest(F.col("text")).alias("actual"))


def gone(spark: SparkSession, folder: str) -> DataFrame:
    source = F.concat(F.lit("bench"), F.floor(F.char_length("text") / 100).cast("string"))
    return table(spark, folder, "benchmark").select(F.lit("en").alias("lang"), source.alias("source"), (F.col("item_id") + GONE).alias("doc_id"), "text")


def expected(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    documents = table(spark, folder, "documents").join(marks, "doc_id", "left")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("#v1"))).otherwise(F.col("text"))
    recorded = documents.filter("quality is null or quality = 1 or toxic = 1").select(*INDEX, digest(text).alias("expected"))
    return recorded.union(gone(spark, folder).select(*INDEX, digest(F.col("text")).alias("expected")))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    kept = labelled.select(digest(F.col("text")).alias("version"), F.when(F.col("toxic") == 1, "azure1").otherwise("local").alias("storage_name"))
    items = gone(spark, folder).filter(F.char_length("text") >= 200).select(digest(F.col("text")).alias("version"), F.lit("local").alias("storage_name"))
    return kept.union(items).distinct()


SQL = f"""
item as (select lang, source, doc_id, upper(sha256(text)) as actual from documents),
gone as (select 'en' as lang, 'bench' || cast(cast(floor(length(text) / 100) as bigint) as varchar) as source, item_id + {GONE} as doc_id, text from benchmark),
marks as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id),
expected as (
  select lang, source, d.doc_id, upper(sha256(case when toxic = 1 then text || '#v1' else text end)) as expected
  from documents d left join marks m on d.doc_id = m.doc_id where quality is null or quality = 1 or toxic = 1
  union all select lang, source, doc_id, upper(sha256(text)) from gone),
stored as (
  select distinct upper(sha256(text)) as version, case when toxic = 1 then 'azure1' else 'local' end as storage_name from documents d join labels l on d.doc_id = l.doc_id
  union select upper(sha256(text)), 'local' from gone where length(text) >= 200),
elements as (
  select coalesce(e.lang, i.lang) as lang, coalesce(e.source, i.source) as source, coalesce(e.doc_id, i.doc_id) as doc_id, expected, actual,
    expected in (select version from stored) as in_store
  from expected e full outer join item i on e.lang = i.lang and e.source = i.source and e.doc_id = i.doc_id),
status as (
  select *, case when expected is null then 'LocalUnexpected' when expected = actual then 'Local' when actual is not null then 'LocalUnexpected'
    when in_store then 'Remote' else 'NotFound' end as status from elements)
"""
