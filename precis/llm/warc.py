"""WARC archives with revisit resolution (operator 7).

Headers are shuffled by payload digest, records join the original response of
their digest, and deduplicated archives are written with fresh headers: a
revisit record carries no payload.  Spark's text writer makes the archives (a
record ends with CRLF CRLF, which is the writer's line separator), so any file
system of the session and its commit protocol apply; each file is one gzip
stream.  They are read back file by file, record by record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import load
from precis.plans.registry import register
from precis.session import scratch_path

CRLF = "\r\n"
#: format tokens of WARC 1.1 and its revisit profile
VERSION = "WARC/1.1"
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: 160 bits are eight groups of
    five hex digits, each four symbols."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            min_payload: int = 0) -> DataFrame:
    """(page_id, url, body, payload_bytes, payload_digest, refers_to): refers_to
    is null for responses.

    Of records with equal payloads of at least ``min_payload`` bytes, that with
    the largest page_id is the response (null ids count lowest, repeated rows
    of the largest id are all responses).  Only (digest, largest id) pairs,
    combined before the shuffle, are aggregated; AQE splits a hot digest in the
    join."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    raw = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                       body.alias("body"))
    raw = raw.withColumns({"payload_bytes": F.octet_length("body").cast("long"),
                           "payload_digest": base32_sha1(F.col("body").cast("binary"))})
    originals = (raw.filter(F.col("payload_bytes") >= min_payload)
                 .groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
                 .agg(F.max("page_id").alias("original")))
    same = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (raw.join(originals, same, "left").drop("d", "b")
            .withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original"))


def record(df: DataFrame) -> DataFrame:
    """One column: each row's WARC record without its closing CRLF CRLF."""
    response = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
                          + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    head = F.concat_ws(
        CRLF, F.lit(VERSION), F.when(response, F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(~response, F.lit("WARC-Profile: " + PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    return (df.withColumn("block", F.when(response, F.concat(http, F.col("body"))).otherwise(http))
            .select(F.concat(head, F.lit(CRLF + CRLF), F.col("block")).alias("value")))


def write_archives(resolved: DataFrame, path: str) -> None:
    """Write the records of ``resolve`` under ``path`` (gzip); one file per
    partition, which AQE keeps near its advisory size."""
    record(resolved).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a gzip stream, decompressed as they are asked for."""

    def __init__(self, packed: bytes, step: int = 1 << 18):
        self.packed, self.step, self.at, self.held = memoryview(packed), step, 0, bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.packed):
            return False
        self.held += self.inflate.decompress(self.packed[self.at:self.at + self.step])
        self.at += self.step
        if self.inflate.eof and self.inflate.unused_data:  # a further gzip member
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.held += self.inflate.decompress(rest)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[:k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    stream = _Stream(packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")


READ = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``; payload_bytes and digest are of
    the payload itself for responses; a revisit's payload_bytes is null until it
    meets its response.  ``payloads`` false leaves the payload null."""

    def read(batches):
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for fields, block in parse(memoryview(blob.as_buffer())):
                    body = block.partition(b"\r\n\r\n")[2]
                    response = fields["warc-type"] == "response"
                    rows.append((
                        fields["warc-record-id"][10:-1], fields["warc-target-uri"], fields["warc-type"],
                        base64.b32encode(hashlib.sha1(body).digest()).decode() if response
                        else fields["warc-payload-digest"][5:],
                        fields.get("warc-refers-to", "<urn:page:>")[10:-1], len(body) if response else None,
                        body if response and payloads else None))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    number = [[int(x) if x else None for x in cols[k]] for k in (0, 4)]
    return pa.RecordBatch.from_arrays(
        [pa.array(number[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
         pa.array(cols[3], pa.string()), pa.array(number[1], pa.int64()), pa.array(cols[5], pa.int64()),
         pa.array(cols[6], pa.binary())],
        names=["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"])


def archive_round_trip(pages: DataFrame, path: str, min_payload: int = 0) -> DataFrame:
    """Write deduplicated archives of ``pages`` and read them back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload, a null url an empty one, a null page_id stays
    null.  On reading, a revisit gets the payload length of the response of its
    digest (headers only, shuffled by digest).  Empty table: empty result."""
    write_archives(resolve(pages, min_payload=min_payload), path)
    read = read_archives(pages.sparkSession, path, payloads=False)
    lengths = (read.filter(F.col("record_type") == "response").groupBy(F.col("payload_digest").alias("d"))
               .agg(F.max("payload_bytes").alias("whole")))
    return (read.join(lengths, F.col("payload_digest") == F.col("d"), "left")
            .select("page_id", F.coalesce("payload_bytes", "whole").alias("payload_bytes"), "payload_digest",
                    "record_type", "refers_to"))


SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS original FROM t)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {{groups}} AS payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
""".replace("{groups}", " || ".join(
    f"substr('{BASE32}', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31) + 1)::INT, 1)"
    for k in range(8) for j in range(4)))


@register("op7_warc_revisits", SQL)
def op7_warc_revisits(spark, sf_dir):
    """Every page as the record that the archives hold."""
    return archive_round_trip(load(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
