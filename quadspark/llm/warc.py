"""WARC: a content-addressed archive of web records, and plain WARC files.

An archive is two tables in a folder: `headers` has the exact header block of every record, the HTTP head that its block starts
with and the SHA-256 of its payload, `payloads` has each payload once under its SHA-256.  Records are rebuilt by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 characters."""
    digits = F.sha1(payload)
    chars = []
    for i in range(8):
        v = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def _uri(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _sha512(payload: Column) -> list[Column]:
    """The first 240 bits of the SHA-512 as four numbers, which aggregate without strings."""
    digits = F.sha2(payload, 512)
    return [F.conv(F.substring(digits, 15 * i + 1, 15), 16, 10).cast("long").alias(f"d{i}") for i in range(4)]


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> None:
    """Writes a record for each row into a content-addressed archive at `path`.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the largest id is a response and the others are
    revisits that refer to it; rows with smaller payloads are all responses.  A null payload is empty; a null id counts
    as the least and its record has no page id; rows that repeat the response's id are responses too.  Line ends in a URL
    are percent-encoded.  Every record has an id of its own (a random UUID) and the time of `date_col` (null or no column:
    the time of writing).  Blocks are HTTP messages: a head with the payload's type and length, and the payload, which a
    revisit leaves out.  That equal SHA-256 digests mean equal payloads is verified by their lengths and SHA-512 when written.
    """
    ws = Workspace(pages.sparkSession, "warc")
    col = lambda c: F.col(f"`{c}`")
    payload = F.coalesce(col(payload_col), F.lit(b"")) if dict(pages.dtypes)[payload_col] == "binary" else F.encode(F.coalesce(col(payload_col).cast("string"), F.lit("")), "UTF-8")
    now = F.current_timestamp()
    at = F.coalesce(col(date_col).cast("timestamp"), now) if date_col else now
    date = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(col(id_col).cast("long").alias("id"), _uri(col(url_col).cast("string")).alias("url"), date.alias("date"), payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    keys = ws.table(rows.select("id", "url", "date", F.expr("uuid()").alias("record"), "sha256", F.octet_length("payload").cast("long").alias("bytes"), *_sha512(F.col("payload")), base32_sha1(F.col("payload")).alias("sha1")), "keys")
    check = ("bytes", "d0", "d1", "d2", "d3")
    # the response: nulls order first, and of several rows with its id the one with the largest record id is named by revisits
    ends = [g(c).alias(f"{g.__name__}_{c}") for c in check for g in (F.min, F.max)]
    groups = keys.groupBy("sha256").agg(F.max(F.struct("id", "record", "url", "date")).alias("last"), F.count(F.lit(1)).alias("n"), *ends)
    same = reduce(Column.__and__, [F.col(f"min_{c}") == F.col(f"max_{c}") for c in check])
    top = F.when(same, F.col("last.id")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("top")
    groups = ws.table(groups.select(F.col("sha256").alias("of"), top, F.when(F.col("n") > 1, F.struct("last.record", "last.url", "last.date")).alias("to")), "groups")
    rec = keys.join(groups, F.col("sha256") == F.col("of"))
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("top"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    number = lambda name, c: F.when(c.isNotNull(), field(name, c.cast("string"))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), field("Content-Length", F.col("bytes").cast("string")), F.lit(_CRLF))
    block = F.octet_length(http).cast("long") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    refers = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}"),
        field("WARC-Refers-To", urn(F.col("to.record"))),
        field("WARC-Refers-To-Target-URI", F.col("to.url")), field("WARC-Refers-To-Date", F.col("to.date")), number("X-Refers-To-Page", F.col("top")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", urn(F.col("record"))), number("X-Page", F.col("id")), field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", F.col("date")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, refers).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", block.cast("string")), F.lit(_CRLF),
    )
    rec.select(F.encode(head, "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http"), "sha256").write.parquet(f"{path}/headers")
    # each payload travels once: from a row with the largest id
    at = lambda c: (F.coalesce(c, F.lit(0)), c.isNull())
    one = groups.select("of", *[k.alias(n) for n, k in zip(("at", "none"), at(F.col("top")), strict=True)])
    held = rows.select("payload", "sha256", *[k.alias(n) for n, k in zip(("at0", "none0"), at(F.col("id")), strict=True)])
    held = held.join(one, (F.col("sha256") == F.col("of")) & (F.col("at0") == F.col("at")) & (F.col("none0") == F.col("none")))
    held.groupBy("of", "at", "none").agg(F.first("payload").alias("payload")).select(F.col("of").alias("sha256"), "payload").write.parquet(f"{path}/payloads")
    ws.clear()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilds the records of an archive: page_id, url, record_type, refers_to, payload_bytes and payload_digest (both of the
    full payload), and record (the exact bytes; the block of a revisit ends with its HTTP head).

    A payload whose digests do not match stops the read.
    """
    held = spark.read.parquet(f"{path}/payloads")
    ok = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    held = held.select(F.col("sha256").alias("of"), F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload"))
    held = held.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    head = F.decode("header", "UTF-8")
    line = lambda k: F.regexp_extract(head, rf"\r\n{k}: ([^\r\n]*)", 1)
    number = lambda k: F.nullif(line(k), F.lit("")).cast("long")
    heads = spark.read.parquet(f"{path}/headers")
    heads = heads.select("header", "http", "sha256", number("X-Page").alias("page_id"), line("WARC-Target-URI").alias("url"), line("WARC-Type").alias("record_type"), number("X-Refers-To-Page").alias("refers_to"), line("WARC-Payload-Digest").alias("said"), line("Content-Length").cast("long").alias("block"))
    out = heads.join(held, F.col("sha256") == F.col("of"))
    revisit = F.col("record_type") == "revisit"
    match = (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("block") == F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")))
    digest = F.when(match, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header does not match its payload")))
    end = F.encode(F.lit(_CRLF + _CRLF), "UTF-8")
    record = F.concat("header", "http", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), end)
    return out.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", record.alias("record"))


def export_warc(records: DataFrame, path: str, files: int) -> None:
    """Writes the records as about `files` plain WARC files; the writer's line end is each record's last two line ends."""
    text = F.substring(F.col("record"), 1, F.octet_length("record") - 4).cast("string")
    records.select(text.alias("value")).repartition(files).write.option("lineSep", _CRLF + _CRLF).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            heads, blocks, at = [], [], 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                n = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", data[at:end])[1])
                heads.append(data[at:end])
                blocks.append(data[end : end + n])
                at = end + n + 4
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(blocks, pa.binary())], ["header", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of every record in uncompressed WARC files; a task holds one file at a time."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, "header binary, block binary")
