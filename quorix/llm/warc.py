"""WARC archives: payload digests, revisit resolution, writing and reading back.

Records are written through Spark's text writer, gzipped, one record a row with CRLF CRLF as the line end, so any
Hadoop file system works and the commit protocol keeps the files whole when a task is run again. Reading
takes whole archives (their size is bounded when they are written) and walks them by Content-Length.

Revisit resolution shuffles headers only (id, digest, length, target): of the records with equal payload the
one with the largest id stays a response, the others become revisit records without payload that refer to it.
Payloads meet their verdict by id and digest, which are spread evenly however large a group of copies is.

Cases: null html is the empty payload; payloads under `least_bytes` are always responses; a null id is below
every other id; rows repeated whole with the largest id are all responses with the same record id; a null URL
leaves out the target header and control characters in a URL are percent-encoded; an empty table writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import spread_join

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_SUFFIX = "<urn:x-page:", ">"
RECORD_SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 5 bytes are 8 digits of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(common.named(html), F.lit(""))
    return pages.select(common.named(page_id).alias("page_id"), common.named(url).alias("url"), payload.alias("html")).withColumns(
        {"digest": base32_sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")}
    )


def resolve_revisits(headers: DataFrame, least_bytes: int = 0, rows: int | None = None) -> DataFrame:
    """headers (page_id, digest, n) -> one row for each distinct header with refers_to, null for responses.

    The few digests that more than a thousandth of all rows have are broadcast, so that no task gets a group of copies.
    """
    once = headers.distinct()
    bound = F.col("n") >= least_bytes
    originals = headers.where(bound).groupBy("digest").agg(F.max("page_id").alias("_original"), F.count("*").alias("_copies"))
    joined = spread_join(once.where(bound), originals, "digest", "_copies", headers.count() if rows is None else rows)
    revisit = ~F.col("page_id").eqNullSafe(F.col("_original"))
    found = joined.select("page_id", "digest", "n", F.when(revisit, F.col("_original")).alias("refers_to"))
    return found.union(once.where(~bound).select("page_id", "digest", "n", F.lit(None).cast(headers.schema["page_id"].dataType)))


def _record(date: str) -> Column:
    """Header block and content of a record; the writer's line end closes it."""
    name = lambda c: F.concat(F.lit(ID_PREFIX), F.coalesce(c.cast("string"), F.lit("")), F.lit(ID_SUFFIX))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    return F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}{CRLF}"), F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", safe)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), line("Content-Length", block.cast("string")), F.lit(CRLF),
        http, F.when(revisit, "").otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 16 << 20, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Deduplicated archives of about archive_bytes each under path, one record a row of pages."""
    spark = pages.sparkSession
    keyed = _keyed(pages, page_id, url, html)
    # A key without nulls, so that the join uses the partitions that the pages are placed in.
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    verdicts = resolve_revisits(keyed.select("page_id", "digest", "n"), least_bytes, pages.count()).select(name.alias("_id"), "digest", "refers_to")
    total = pages.agg(F.sum(F.octet_length(common.named(html)))).first()[0] or 0
    files = max(common.n_partitions(spark), -(-int(total) // archive_bytes))
    # One shuffle of the pages by id places them, joins the verdict and sets the size of the archives.
    placed = keyed.withColumn("_id", name).repartition(files, "_id", "digest")
    joined = placed.join(verdicts, ["_id", "digest"])
    joined.select(_record(date).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").mode("errorifexists").text(path)


def _header(block: bytes) -> dict[bytes, bytes]:
    lines = block.split(b"\r\n")
    return dict(line.split(b": ", 1) for line in lines[1:] if b": " in line)


def _page(name: bytes | None) -> int | None:
    digits = (name or b"")[len(ID_PREFIX) : -len(ID_SUFFIX)]
    return int(digits) if digits else None


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of an archive; length and digest of a response are those of the payload found."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        if data[at : at + len(VERSION)] != VERSION.encode():
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = _header(data[at:end])
        start, length = end + 4, int(head[b"Content-Length"])
        at = start + length + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        size = None
        if kind == "response":
            payload = view[data.index(b"\r\n\r\n", start) + 4 : start + length]
            size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest:
                raise ValueError(f"the payload at byte {start} does not have its digest")
        yield _page(head[b"WARC-Record-ID"]), kind, head.get(b"WARC-Target-URI", b"").decode() or None, digest, size, _page(head.get(b"WARC-Refers-To"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
    for batch in batches:
        for content in batch.column(0):
            rows = list(parse_archive(gzip.decompress(content.as_py())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path; a revisit has the length of the response that it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = common.cut(files.mapInArrow(_parse, RECORD_SCHEMA))  # headers only, each archive is walked once
    rows = records.count()
    size = F.max(F.when(F.col("record_type") == "response", F.col("payload_bytes")))
    responses = records.groupBy("payload_digest").agg(size.alias("_bytes"), F.count_if(F.col("record_type") == "revisit").alias("_copies"))
    revisits = spread_join(records.where("record_type = 'revisit'").drop("payload_bytes"), responses, "payload_digest", "_copies", rows).withColumnRenamed("_bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return records.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).drop("target_uri")


#: Base 32 of a digest in SQL: 4 groups of 5 bytes, 8 digits each.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS o FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> o THEN o END AS refers_to FROM m
"""
