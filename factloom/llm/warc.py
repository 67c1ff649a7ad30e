"""WARC archives with revisit resolution.

Headers alone are shuffled by payload digest to find the original response of every
record; archives are then written with fresh headers, each payload once, and later
copies as revisit records that name the original. Reading resolves revisits the same way: headers by digest,
joined to the responses.

Records are made and written by Spark's text writer, one file per so many records,
and files are read whole, one to a task at a time, and walked by Content-Length.
"""

from __future__ import annotations

import functools
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import join_rows, save
from factloom.session import scratch_path

FILE_RECORDS = 2048
#: and of their bytes, before compression: a reader holds one file
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id bigint, refers_to bigint, type string, url string, digest string, payload binary"


def payload_digest(payload: str | Column) -> Column:
    """Bare upper-case base32 SHA-1."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``headers`` (page_id, payload_digest, payload_bytes, ...) with ``record_type`` and ``refers_to``.

    Of records with equal payloads of at least ``least_bytes`` that of the smallest page_id is the response, the others
    revisit it. Records that share that page_id and payload are all responses; one without page_id never is if another has one.
    Only distinct digests are aggregated to one row each, combined before the shuffle; they are written, so that a join may split a
    payload that a third of all pages have.
    """
    first = save(headers.groupBy("payload_digest").agg(F.min("page_id").alias("first")), "first-payloads")
    joined = headers.join(first, "payload_digest")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("first"))).drop("first")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record per row of (page_id, url, html, payload_digest, record_type, refers_to), without its last line feed."""
    payload = F.coalesce("html", F.lit(""))
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(response, F.concat(http, payload)).otherwise(http)
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit("\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {_IDENTICAL}"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = DATE, file_records: int = FILE_RECORDS, compression: str = "gzip",
                   file_bytes: int = FILE_BYTES, largest: int | None = None) -> None:
    """Write resolved ``pages`` as WARC files of at most ``file_records`` records and about ``file_bytes`` each, whatever pages are like.

    Pages of like size share files: of pages of up to 2^k bytes, a file holds as many as fit. A page of more than
    ``file_bytes`` has a file of its own. ``largest``: the bytes of the largest page, where they are known.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    if largest is None:
        largest = pages.agg(F.max(size)).first()[0] or 0
    low, high = -1, max(1, file_bytes // file_records)  # pages up to this size are bounded by their number alone
    while low < largest or low < 0:
        within = pages.where((size > low) & (size <= high)) if low >= 0 or largest > high else pages
        records(within, date).write.mode("append").option("maxRecordsPerFile", max(1, min(file_records, file_bytes // high))).option(
            "compression", compression).option("lineSep", "\n").text(path)
        low, high = high, high * 8


def _walk(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        size = int(head["content-length"])
        yield head, data[start:start + size]
        at = start + size + 4


def _page(urn: str | None):
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def _inflated(data: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while data:
        member = zlib.decompressobj(47)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = _inflated(data)
            rows = []

            def flushed(rows=rows):
                names = ["page_id", "refers_to", "type", "url", "digest", "payload"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

            for head, block in _walk(data):
                _, _, payload = block.partition(b"\r\n\r\n")
                rows.append((
                    _page(head["warc-record-id"]), _page(head.get("warc-refers-to")), head["warc-type"], head.get("warc-target-uri"),
                    head["warc-payload-digest"].removeprefix("sha1:"), payload if head["warc-type"] == "response" else None))
                if len(rows) == 256:
                    yield flushed(rows)
                    rows.clear()
            if rows:
                yield flushed(rows)


def read_archives(spark, path: str) -> DataFrame:
    """The records of WARC files: page_id, refers_to, type, url, digest, payload (null for revisits)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, _RECORD)


def restored(archive: DataFrame) -> DataFrame:
    """Headers of ``read_archives`` with the length and digest of the full payload, revisits joined to their originals."""
    heads = archive.select(
        "page_id", "refers_to", "type", F.when(F.col("type") == "response", payload_digest("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    heads = save(heads, "headers")
    originals = save(heads.where("type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes")), "originals")
    return heads.join(originals, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")


def deduplicate(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives that hold each payload once, and read the headers back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, a row per record. A null html is an empty payload, a null
    url leaves the header out, control characters of a url are escaped. A null page_id is kept as such. Repeated
    rows are records of their own. Other columns are ignored; an empty table gives no archive and an empty result.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn(
        "payload_digest", payload_digest(F.coalesce("html", F.lit("")).cast("binary")))
    headers = save(rows.select("page_id", "payload_digest", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("payload_bytes")), "headers")
    decided = resolve(headers, least_bytes).select("page_id", "payload_digest", "record_type", "refers_to").distinct()
    largest = headers.agg(F.max("payload_bytes")).first()[0] or 0
    write_archives(join_rows(rows, decided, ["page_id", "payload_digest"], "inner"), path, date, largest=largest)
    return restored(read_archives(pages.sparkSession, path))


def archive_folder(spark) -> str:
    return scratch_path(spark, "archives")
