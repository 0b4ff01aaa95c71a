"""Operator 2: a content-addressed archive of web records.

An archive is two tables in one folder: ``payloads`` (each payload's bytes once, by SHA-256) and ``headers`` (each
record's exact header bytes and the digest of its payload). Records are put together again by a join on the digest, and
can be exported to and read from plain WARC/1.1 files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Payloads shorter than this are stored with each record as a response.
LEAST = 100
#: The date of records whose table has none; records in a plain file at most.
DATE, PER_FILE = "1970-01-01T00:00:00Z", 50_000
#: Fixed values of the record format.
VERSION, CRLF, PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _headers(x: DataFrame) -> F.Column:
    """The header lines up to the empty line, as a WARC writer would put them before the payload."""
    name = F.when(F.col("page_id").isNull(), F.lit("none")).otherwise(F.col("page_id").cast("string"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), "n_bytes"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), "refers_to", F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("n_bytes"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """One record per row of ``pages``.

    Of records with equal payloads of at least 100 bytes, that with the smallest id is a response and the others revisit
    it; smaller payloads are all responses. A null payload is empty. Rows that repeat an id are records of their own: of
    equal ones with the smallest id all are responses, as a record can't revisit itself. A record without an id revisits
    one that has an id, and is a response if there is none. An empty table gives an empty archive.
    """
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    x = x.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long"), "date": F.lit(date)})
    # the payload moves once for each digest and map task: tasks keep one copy before anything is sent
    payloads = x.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.count("*").alias("records"))
    payloads.write.parquet(f"{path}/payloads", compression="zstd")
    shared = x.sparkSession.read.schema("digest string, payload binary, first_id long, records long").parquet(f"{path}/payloads").where("records > 1 and octet_length(payload) >= %d" % LEAST).select("digest", "first_id")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    headers = x.drop("payload").join(shared, "digest", "left").select("page_id", "url", "digest", "n_bytes", "date", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"))
    headers.select("page_id", "digest", _headers(headers).cast("binary").alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload (the full bytes, for revisits too), digest, n_bytes: every record, by a join on the digest.

    ``digest`` and ``n_bytes`` are computed from the stored bytes; bytes that don't match the digest they are stored under
    end the job.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    checked = stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))).alias("actual"))
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers")
    return headers.join(checked, "digest").select("page_id", "header", "payload", F.col("actual").alias("digest"), "n_bytes")


def header_field(name: str) -> F.Column:
    """A field's value from ``header``, null where the header lacks it."""
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def records_summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the headers and payloads of ``records`` say."""
    return records.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), header_field("WARC-Type").alias("record_type"), F.regexp_extract(header_field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to"))


def export_warc(records: DataFrame, path: str) -> None:
    """Plain WARC/1.1 files of at most ``PER_FILE`` records: header, payload (none for revisits), two line ends. Spark's text writer keeps the bytes as they are."""
    revisit = header_field("WARC-Type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    records.select(F.concat("header", body).cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", PER_FILE).text(path)


def _field(header: bytes, name: bytes) -> bytes | None:
    """The value of a header's first field ``name``, in whatever case it is written."""
    for line in header.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def _cut_records(raw: bytes) -> Iterator[tuple[bytes, bytes, str]]:
    """header, payload and the payload's digest of each record in ``raw``."""
    at = 0
    while (end := raw.find(b"\r\n\r\n", at)) >= 0:
        header, start = raw[at : end + 4], end + 4
        length = _field(header, b"Content-Length")
        if length is None or not length.isdigit():
            raise ValueError(f"no Content-Length in {header[:200]!r}")
        at = start + int(length)
        if at > len(raw):
            raise ValueError(f"file ends within the payload of {header[:200]!r}")
        payload = raw[start:at]
        digest = hashlib.sha256(payload).hexdigest()
        told = _field(header, b"WARC-Payload-Digest") or b""
        if _field(header, b"WARC-Type") != b"revisit" and told.startswith(b"sha256:") and told != b"sha256:" + digest.encode():
            raise ValueError(f"payload differs from its header's digest: {header[:200]!r}")
        yield header, payload, digest
        at += 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, payload, digest: the records of WARC files, cut by their Content-Length, so payloads may hold anything.

    A file is one task's work; its records leave it in batches of about 8 MB. A response whose payload doesn't match the
    digest in its header, a record without a Content-Length and one that the file cuts short end the job; an empty file
    has no records.
    """

    def batch(rows: list[tuple[bytes, bytes, str]]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["header", "payload", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                for record in _cut_records(content.as_py()):
                    rows.append(record)
                    held += len(record[0]) + len(record[1])
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary, digest string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, archived and read back."""
    path = scratch(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return records_summary(read_records(spark, path))


#: The same rows from the table itself.
OP2_SQL = """
with x as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
     y as (select *, min(page_id) over (partition by digest) as first_id from x)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first_id then first_id end as refers_to
from y
"""
