"""WARC archives: written with revisit records, read back by boundary-chain verification.

Writing: each page is a record, written by Spark's text writer with the record separator as line separator;
pages of similar size share files, the fewer of them the larger they are, so that a file has at most some
``FILE_BYTES`` (or one record). Of pages with equal payloads of at least ``LEAST_BYTES`` bytes, that with the
smallest page_id is a response record; the others are revisit records that refer to it.

Reading: a magic string may also stand inside a payload. Tasks look for the magic in the archive files (each
at most 2 GB, Spark's limit for binary files), at their start and after an empty line, so that the headers tried don't overlap, and
emit, for each place that parses as a record header, a link from its offset to the offset where the header's Content-Length (1 to 18
ASCII digits) says the next record begins. Pointer jumping doubles the followed distance in each round of joins; a record is real if
the chain from its file's start reaches it. Bodies are hashed where they are found, as long as no byte is in more than
``NESTED`` of them; those of real records that were left out, as forged headers claimed their bytes before, are hashed afterwards.

Defined cases: a null html is an empty payload; repeated page_ids are records each (a revisit refers to the
smallest page_id of its payload; rows that repeat that page_id are responses too);
a null page_id sorts last and is written as an empty id; a null url as an empty one; control characters in urls are
percent-encoded; an empty table gives no records. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, settle, with_ids

LEAST_BYTES = 100
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: records of one archive file at most, and bytes of one with several records, about
FILE_RECORDS, FILE_BYTES = 1000, 32 << 20
#: payload digests with copies that are broadcast at most, about 100 bytes each; more are joined by shuffle
BROADCAST_KEYS = 1 << 17
#: bodies of candidates over one byte that are hashed at once
NESTED = 4


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, refers_to (null: response), html of each row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    size, digest = F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    first = (
        pages.select("page_id", size, digest)
        .filter(F.col("payload_bytes") >= LEAST_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    first = settle(first, "copies")
    if first.count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), size, digest)
    joined = rows.join(first, "payload_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("n").isNotNull(), refers).alias("refers_to"))


def record(header: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in header]
    return F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), body)


def write_warc(pages: DataFrame, path: str) -> None:
    rows = classified(pages)
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", named("page_id")),
        ("WARC-Target-URI", clean),
        ("WARC-Refers-To", F.when(revisit, named("refers_to")).otherwise(F.lit(""))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Length", F.octet_length(F.encode(body, "UTF-8")).cast("string")),
    ]
    low, most = 0, FILE_BYTES // FILE_RECORDS
    while True:  # records up to 1/1000, 1/125, 1/15 of a file's bytes, and larger ones
        here = F.col("payload_bytes") >= low if most > FILE_BYTES // 8 else (F.col("payload_bytes") >= low) & (F.col("payload_bytes") < most)
        written = rows.filter(here).select(record(header, body).alias("value")).write.mode("append").option("lineSep", END)
        written.option("maxRecordsPerFile", max(1, FILE_BYTES // most) if most <= FILE_BYTES // 8 else 1).text(path)
        if most > FILE_BYTES // 8:
            return
        low, most = most, most * 8


_LENGTH = re.compile("[0-9]{1,18}")


_PLACE = re.compile(rb"(?:\A|(?<=\r\n\r\n))" + re.escape(MAGIC.encode()))


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of a record header at this place and where its body begins; None if it isn't one. Reads as far as the first line
    that is no field."""
    fields: dict[str, str] = {}
    begin = at + len(MAGIC)
    while (stop := data.find(b"\r\n", begin)) > begin:
        name, colon, value = data[begin:stop].partition(b": ")
        name = name.decode("utf-8", "replace")
        if not colon or name in fields:
            return None
        fields[name] = value.decode("utf-8", "replace")
        begin = stop + 2
    good = stop == begin and _LENGTH.fullmatch(fields.get("Content-Length", "")) and "WARC-Type" in fields
    return (fields, stop + 2) if good else None


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """file (a number made from its path), content. Two paths with one number are an error."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.xxhash64("path").alias("file"), "content")
    numbers = files.agg(F.count("*"), F.count_distinct("file")).first()
    if numbers[0] != numbers[1]:
        raise ValueError("two archive files have the same number")
    return files


def candidates(files: DataFrame) -> DataFrame:
    """file, offset, next, with the record's fields and its body's place and digest (null: too many bodies over one byte), for every
    place that looks like a record."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["content"], strict=True):
                rows, over = [], []  # ends of the bodies that are hashed and go on here
                for m in _PLACE.finditer(data):
                    if got := _header(data, m.start()):
                        fields, body = got
                        stop = body + int(fields["Content-Length"])
                        if data[stop : stop + 4] == END.encode():
                            over = [x for x in over if x > body]
                            digest = None
                            if len(over) < NESTED:
                                digest = hashlib.sha256(memoryview(data)[body:stop]).hexdigest()
                                over.append(stop)
                            rows.append((file, m.start(), stop + 4, fields["WARC-Type"], fields.get("WARC-Record-ID", ""), fields.get("WARC-Refers-To", ""), fields.get("WARC-Payload-Digest", ""), fields.get("WARC-Payload-Length", ""), body, stop - body, digest))
                yield pd.DataFrame(rows, columns=["file", "offset", "next", "record_type", "record_id", "refers", "said_digest", "said_bytes", "body", "body_bytes", "body_digest"])

    return files.mapInPandas(look, "file long, offset long, next long, record_type string, record_id string, refers string, said_digest string, said_bytes string, body long, body_bytes long, body_digest string")


def late_digests(files: DataFrame, late: DataFrame) -> DataFrame:
    """file, offset, late_digest of records (file, offset, body, body_bytes), from the files that hold any: a file's records go to it as a list."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data, records in zip(batch["file"], batch["content"], batch["records"], strict=True):
                rows = [(file, r["offset"], hashlib.sha256(memoryview(data)[r["body"] : r["body"] + r["body_bytes"]]).hexdigest()) for r in records]
                yield pd.DataFrame(rows, columns=["file", "offset", "late_digest"])

    lists = settle(late.groupBy("file").agg(F.collect_list(F.struct("offset", "body", "body_bytes")).alias("records")), "late")
    return with_ids(files, "file", lists.select("file")).join(lists, "file").mapInPandas(digest, "file long, offset long, late_digest string")


def reachable(links: DataFrame) -> DataFrame:
    """file, offset of the links (file, offset, next) on the chain from each file's start, by pointer jumping.

    In round k a link spans 2 ** k records; the reached set doubles with each round.
    """
    spans = settle(links.select("file", "offset", "next"), "links")
    reached = settle(spans.filter("offset = 0").select("file", "offset"), "reached")
    n = reached.count()
    while True:
        # all sides grow with the archives: none is to be broadcast, however small it looks when compressed
        hops = reached.join(spans.hint("merge"), ["file", "offset"]).select("file", F.col("next").alias("offset"))
        real = hops.join(links.select("file", "offset").hint("merge"), ["file", "offset"], "left_semi")
        reached = settle(reached.union(real).distinct(), "reached")
        if (now := reached.count()) == n:
            return reached
        n = now
        after = spans.select("file", F.col("offset").alias("next"), F.col("next").alias("then"))
        spans = settle(spans.join(after.hint("merge"), ["file", "next"]).select("file", "offset", F.col("then").alias("next")), "links")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The real records of the archives at a path."""
    files = archive_files(spark, path)
    found = settle(candidates(files), "candidates")
    real = found.join(reachable(found).hint("merge"), ["file", "offset"])
    late = found.filter("body_digest is null")
    if late.isEmpty():
        return real.drop("body")
    real = settle(real, "real")
    late = late_digests(files, real.filter("body_digest is null"))
    joined = real.join(settle(late, "digests"), ["file", "offset"], "left")
    return joined.withColumn("body_digest", F.coalesce("body_digest", "late_digest")).drop("body", "late_digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all read back from archives of the pages.

    A response's digest is that of its body as read; a revisit's that of the response it refers to.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    records = settle(
        read_warc(spark, path).select(
            number("record_id").alias("page_id"), "record_type", number("refers").alias("refers_to"), "body_bytes", "body_digest", "said_digest", "said_bytes"
        ),
        "records",
    )
    responses = records.filter("record_type = 'response'")
    originals = responses.select(F.col("page_id").alias("original"), F.col("body_bytes").alias("full_bytes"), F.col("body_digest").alias("full_digest")).dropDuplicates(["original", "full_digest"])
    revisits = records.filter("record_type = 'revisit'").join(originals.hint("merge"), (F.col("refers_to") == F.col("original")) & (F.col("said_digest") == F.concat(F.lit("sha256:"), "full_digest")))
    own = responses.select("page_id", F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.union(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to"))
