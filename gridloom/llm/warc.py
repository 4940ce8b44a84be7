"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gets a metadata record (application/warc-fields, with what was
found in the page and every HTTP header of the response) and a conversion record
(its text). Both name the response
in WARC-Refers-To, and each other in WARC-Concurrent-To; both keep its target,
date and HTTP headers' fields, and have SHA-256 digests of block and payload
beside the payload digest of the source.

All fields are made by DataFrame functions; only writing files needs tasks of
its own. Record ids are UUIDs of the MD5 of what they name, so a run repeated
gives the same records.

Text is taken by dropping scripts, styles and comments, turning block tags into
line ends, dropping other tags, replacing the named entities of markup and
folding white space.

Defined cases: a null or empty page has an empty payload and text, with the
digests of no bytes; a null url becomes an empty target; a null page id gives
ids of "null"; rows that repeat a page give equal records; empty tables give
empty results; extra columns are not carried, so that none clash.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, shared_dir

DATE = "2024-01-01T00:00:00Z"
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|td|table|article|section|nav|title|header|footer"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def record_id(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def text_of(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(page_id).alias("page_id"),
        F.lit("response").alias("warc_type"),
        record_id("response", F.col(page_id), F.col(url)).alias("record_id"),
        F.coalesce(url, F.lit("")).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        head.alias("http_headers"),
        body.alias("payload"),
        digest(body).alias("payload_digest"),
    )


def source_headers(http: Column) -> Column:
    """Every header of a response as a field of its own, in their order, behind the status line."""
    lines = F.filter(F.slice(F.split(http, "\r\n"), 2, 1 << 30), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response."""
    page = F.col("payload")
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    lang = F.regexp_extract(page, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)
    links = F.size(F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*href="), F.lit(0)))
    status = F.regexp_extract("http_headers", r"^HTTP/\S+ ([0-9]+)", 1)
    kind = F.regexp_extract("http_headers", r"(?i)Content-Type: ([^\r\n]*)", 1)
    fields = F.concat(
        F.lit("title: "), F.regexp_replace(title, r"\s+", " "), F.lit("\r\nlanguage: "), lang, F.lit("\r\noutlinks: "), links.cast("string"),
        F.lit("\r\nhttp-status: "), status, F.lit("\r\nsource-content-type: "), kind, F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\n"), source_headers(F.col("http_headers")),
    )
    made = source.withColumns({"__meta": record_id("metadata", F.col("record_id")), "__conv": record_id("conversion", F.col("record_id"))})
    record = lambda t, i, other, c, body: F.struct(F.lit(t).alias("warc_type"), F.col(i).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(c).alias("content_type"), body.alias("content"))
    pair = F.array(record("metadata", "__meta", "__conv", "application/warc-fields", fields), record("conversion", "__conv", "__meta", "text/plain; charset=UTF-8", text_of(page)))
    out = made.select("page_id", "target_uri", "warc_date", F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("source_payload_digest"), status.alias("source_status"), kind.alias("source_content_type"), F.explode(pair).alias("r"))
    return out.select(
        "page_id", "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.content").cast("long").alias("content_length"), digest(F.col("r.content")).alias("block_digest"), digest(F.col("r.content")).alias("payload_digest"),
        "source_status", "source_content_type", "source_payload_digest", "r.content",
    )


HEADERS = (
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("X-Source-Status", "source_status"),
    ("X-Source-Content-Type", "source_content_type"), ("X-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
)


def serialised(records: DataFrame) -> DataFrame:
    """(record_id, record): a record's bytes as WARC/1.1 has them."""
    return records.select("record_id", record_bytes().alias("record"))


def record_bytes() -> Column:
    """The bytes of a row's record: headers, an empty line, content and two line ends."""
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{h}: "), F.col(c).cast("string"), F.lit("\r\n")) for h, c in HEADERS], F.lit("\r\n"))
    return F.concat(head, F.col("content"), F.lit("\r\n\r\n")).cast("binary")


def write(records: DataFrame, folder: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Write .warc.gz files, a gzip member for each record; (path, records, bytes) of the files that count."""
    base = (folder or f"{shared_dir(records.sparkSession)}/gridloom-warc-{uuid.uuid4().hex}").rstrip("/")
    fs, at = file_system(base)
    fs.create_dir(at)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stream, task = [], None, TaskContext.get()
        for b in batches:
            for record in b.column("record").to_pylist():
                if stream is None:
                    path = f"{base}/{task.partitionId():06d}-{len(out):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    there, name = file_system(path)
                    stream, n, size = there.open_output_stream(name, compression=None), 0, 0
                member = gzip.compress(record, mtime=0)
                stream.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    stream.close()
                    out.append((path, n, size))
                    stream = None
        if stream is not None:
            stream.close()
            out.append((path, n, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in out], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut(serialised(records).select("record").mapInArrow(files, "path string, records long, bytes long"))
