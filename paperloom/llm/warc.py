"""WARC archives: writing, and reading by boundary-chain verification.

Records are composed in SQL functions and written by Spark's text writer, whose line end
completes each record, so the files are WARC/1.0, here in one gzip stream each. Reading, each task
looks for the record magic at every byte of its archives and emits a candidate: offset and the offset
of its successor by Content-Length. Magic within payloads gives false candidates. Only those that
pointer jumping reaches from an archive's start are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, joined_small, shared_dir, table, written

#: Payloads of so many bytes are written once.
MIN_BYTES = 0
#: Records of an archive at most, and its bytes of payload by the mean payload: an archive is read as one row.
ARCHIVE_RECORDS = 4096
ARCHIVE_BYTES = 64 << 20
MAGIC = b"WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: each 5 hexadecimal digits are 4 letters."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, per_archive: int = ARCHIVE_RECORDS) -> str:
    """Write one record per row of ``pages`` (page_id, url, html); returns the folder of the archives.

    Of records with the same payload of ``min_bytes`` or more, the one with the largest page_id is the
    response; others are revisits without a payload that name it, its digest and its length. Rows that
    repeat the response's page_id are responses too. Archives of large pages hold fewer records. Null html is an empty payload, null url no target; line
    ends in a url are percent-encoded. A null page_id is written as an empty name and read as null.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_of_sha1(F.sha1(F.encode("html", "utf-8"))))
    same = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    same = written(same.where("n > 1").drop("n"), "warc-copies")
    rows = joined_small(rows, same, ["digest", "bytes"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    fixed = lambda x: F.lit(x)
    name = lambda c: F.concat(fixed("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), fixed(">"))
    record = F.concat(
        fixed("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        fixed("\r\nWARC-Record-ID: "), name(F.col("page_id")), fixed(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(fixed("\r\nWARC-Target-URI: "), url), F.lit("")),
        fixed("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(fixed("\r\nWARC-Refers-To: "), name(F.col("response_id")), fixed("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nX-Payload-Length: "), F.col("bytes").cast("string"))).otherwise(""),
        fixed("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
        fixed("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("html")), fixed("\r\n"),
    )
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    per_archive = max(1, min(per_archive, int(ARCHIVE_BYTES // max(mean, 1))))
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)
    return path


CANDIDATE = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def candidates_of(archive: str, data: bytes):
    """A row for each place where the bytes could start a record."""
    if data[:2] == b"\x1f\x8b":
        whole = []
        while data:  # one gzip member after the other
            d = zlib.decompressobj(31)
            whole.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(whole)
    at = data.find(MAGIC)
    while at >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        head = dict(line.split(b": ", 1) for line in data[at + len(MAGIC) : stop].split(b"\r\n") if b": " in line)
        length = head.get(b"Content-Length", b"")
        if re.fullmatch(rb"\d{1,15}", length):
            a, b = stop + 4, stop + 4 + int(length)
            if data[b : b + 4] == b"\r\n\r\n":  # else it is cut off or no record
                get = lambda k: head.get(k, b"").decode("utf-8", "replace")
                revisit = get(b"WARC-Type") == "revisit"
                said = get(b"X-Payload-Length")
                yield {
                    "archive": archive, "offset": at, "next": b + 4, "kind": get(b"WARC-Type"), "record_id": get(b"WARC-Record-ID"), "refers_to": get(b"WARC-Refers-To") or None,
                    "payload_bytes": (int(said) if said.isdigit() else None) if revisit else b - a,
                    "payload_digest": get(b"WARC-Payload-Digest").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(memoryview(data)[a:b]).digest()).decode(),
                }
        at = data.find(MAGIC, at + 1)


def candidates(spark, path: str) -> DataFrame:
    """All candidates of the archives in a folder, plain or gzip."""

    def scan(batches):
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(candidates_of(archive, data.as_py()))
                yield pa.RecordBatch.from_pylist(rows, schema=CANDIDATE)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "archive string, offset long, next long, kind string, record_id string, refers_to string, payload_bytes long, payload_digest string")


def reachable(found: DataFrame) -> DataFrame:
    """(archive, offset) of the candidates on the chain from offset 0 of each archive, by pointer jumping.

    After round k every pointer spans 2**k records and every record within 2**k of the start is marked, so the
    rounds are the logarithm of the longest chain. Each round is a written table.
    """
    now = found.select("archive", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("reached"))
    now = written(now, "chain")
    most = now.groupBy("archive").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        to = now.select("archive", F.col("offset").alias("jump"), F.col("jump").alias("beyond"), F.col("reached").alias("_there"))
        met = now.join(to.hint("merge"), ["archive", "jump"], "left")
        # Each row keeps its place with a longer pointer; a marked row also marks where its pointer went.
        both = F.array(
            F.struct(F.col("offset"), F.col("beyond").alias("jump"), F.col("reached")),
            F.struct(F.col("jump").alias("offset"), F.lit(None).cast("long").alias("jump"), (F.col("reached") & F.col("_there").isNotNull()).alias("reached")),
        )
        rows = met.select("archive", F.explode(both).alias("r")).select("archive", "r.*").where("jump is not null or reached or offset is not null")
        last, now = now, written(rows.groupBy("archive", "offset").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")).where("offset is not null"), "chain")
        discard(last)
    return now.where("reached").select("archive", "offset")


def read_archives(spark, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the archives."""
    found = written(candidates(spark, path), "warc-candidates")
    out = found.join(reachable(found).hint("merge"), ["archive", "offset"])
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(table(spark, sf_dir, "pages")))


OP7_SQL = f"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), r as (
  select *, count(*) over (partition by hex, payload_bytes) as n, max(page_id) over (partition by hex, payload_bytes) as top from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{BASE32}',
    1 + (((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::integer) >> (15 - 5 * (k % 4))) & 31)::integer, 1)), '') as payload_digest,
  case when payload_bytes >= {MIN_BYTES} and n > 1 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_BYTES} and n > 1 and page_id <> top then top end as refers_to
from r
"""
