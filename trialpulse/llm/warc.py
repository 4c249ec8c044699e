"""Content-addressed WARC archive (operator 4).

An archive is two tables: ``payloads`` (SHA-256, SHA-1, size, bytes: each
distinct payload once), ``headers`` (the exact header bytes of every record and
the SHA-256 of its payload), both Parquet. Reading joins them back, checks both
digests against the bytes, and gives the original records. Of records with equal
payloads, the one with the largest id is the response; the others are revisits
that refer to it and carry no block of their own.

Defined results: a null payload is empty; a null url is left out of the header;
rows with a null id are stored and read back with a null id, and are the
response only where no other row has the payload; of repeated rows with the
largest id the response is all of them.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import frugal, looked_up, staged

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key) -> str:
    """A URI that holds the key, so that a header tells which record it refers to."""
    return f"<urn:x-page:{key}>"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def header(key, url: str | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """WARC header of a record, with the HTTP header that begins its block."""
    http = _http(size)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(pages: DataFrame, to: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record a row under ``to``."""
    frugal(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))

    @K.tidy_batches
    def digest(batches):
        for batch in batches:
            data = [b or b"" for b in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "url": batch.column("url"), "sha256": [hashlib.sha256(b).digest() for b in data], "sha1": [base32_sha1(b) for b in data], "size": pa.array([len(b) for b in data], pa.int64())})

    named = staged(rows.mapInArrow(digest, "key long, url string, sha256 binary, sha1 string, size long"), "named")
    rows.select(F.unhex(F.sha2("payload", 256)).alias("sha256"), "payload").dropDuplicates(["sha256"]).write.parquet(f"{to}/payloads")
    responses = named.groupBy("sha256").agg(F.max("key").alias("response"))

    @K.tidy_batches
    def heads(batches):
        for batch in batches:
            out = []
            for key, url, sha1, size, response in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "sha1", "size", "response"))):
                out.append(header(key, url, sha1, size, None if key == response else response, date))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "response": batch.column("response"), "sha256": batch.column("sha256"), "header": pa.array(out, pa.binary())})

    looked_up(named, responses, "sha256").select("key", "url", "sha256", "sha1", "size", "response").mapInArrow(heads, "key long, response long, sha256 binary, header binary").write.parquet(f"{to}/headers")


def _field(name: str):
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, at: str, with_payload: bool = True) -> DataFrame:
    """The records: key, record_type, refers_to, target_uri, payload_digest, payload_bytes, header and, ``with_payload``, payload. Fails where bytes and digests disagree."""
    heads = spark.read.schema("key long, response long, sha256 binary, header binary").parquet(f"{at}/headers")
    bodies = spark.read.schema("sha256 binary, payload binary").parquet(f"{at}/payloads")

    @K.tidy_batches
    def check(batches):
        for batch in batches:
            data = batch.column("payload").to_pylist()
            for want, got in zip(batch.column("sha256").to_pylist(), data):
                if hashlib.sha256(got).digest() != want:
                    raise ValueError(f"payload {want.hex()} has other bytes")
            out = {"sha256": batch.column("sha256"), "sha1": [base32_sha1(b) for b in data], "payload_bytes": pa.array([len(b) for b in data], pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"payload": batch.column("payload")} if with_payload else {}))

    body = bodies.mapInArrow(check, "sha256 binary, sha1 string, payload_bytes long" + ", payload binary" * with_payload)
    kind = _field("WARC-Type")
    stated = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    records = heads.select("key", "sha256", "header", kind.alias("record_type"), F.when(kind == "revisit", F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")).alias("refers_to"), _field("WARC-Target-URI").alias("target_uri"), stated.alias("payload_digest"))
    # digests are small: those of hot payloads are broadcast. Payloads aren't, and are left to Spark's own splitting of skewed joins
    joined = records.join(body, "sha256") if with_payload else looked_up(records, staged(body, "digests"), "sha256")
    verified = F.when(F.col("payload_digest") == F.col("sha1"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's payload digest is wrong")).cast("string"))
    return joined.select("key", "record_type", "refers_to", "target_uri", verified.alias("payload_digest"), "payload_bytes", "header", *(["payload"] if with_payload else []))


def records(spark: SparkSession, at: str) -> DataFrame:
    """(key, record): each record's exact bytes, its header, its block unless it is a revisit, and the record's end."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read(spark, at).select("key", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
