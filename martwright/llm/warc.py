"""WARC archives: writing deduplicated records and a salvage reader.

Writing uses DataFrame functions only: a record is one string, and Spark's text writer puts the
two line breaks after each. Of records with equal payloads of at least ``min_bytes`` bytes, the
one with the smallest id is a ``response``; the others are ``revisit`` records without payload.

Reading: every file is walked record by record. A record must have a version line, a header block
with the mandatory fields, a content length that ends at two line breaks, and, where it states a payload digest, a payload
with that digest. After a failed check the reader searches for the next valid record or the next
valid gzip member that holds one, whichever comes first and whatever the file starts with,
recovers what follows, and logs the bytes between as a gap.
Files are read whole, one at a time in a task, so the writer bounds the records in a file.

Defined results: a null payload is empty; a null url becomes ``urn:page:<id>``; rows with the same
id and payload are all ``response`` if the id is the smallest; a null id sorts after all others and
is read back as null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.common import stored

RECORD_END = "\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
MARK = re.compile(rb"WARC/1\.|" + re.escape(GZIP))  # where a record or a gzip member can begin
HEADER_LIMIT = 1 << 16
RECORDS_PER_FILE = 2000
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
# Digits of base 32 as Spark's conv writes them, and the alphabet of RFC 4648.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = (
    "kind string, path string, start long, end long, reason string, page_id long, url string, "
    "record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(value: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(value.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def with_roles(pages: DataFrame, page_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``_id``, ``_url``, ``_payload``, ``_digest``, ``_bytes`` and ``_refers_to`` (revisits only)."""
    first = (
        pages.select(page_id, "_digest", "_bytes")
        .where(F.col("_bytes") >= min_bytes)
        .groupBy("_digest")
        .agg(F.min(page_id).alias("_first"), F.count("*").alias("_copies"))
        .where(F.col("_copies") > 1)
        .select(F.col("_digest").alias("_shared"), "_first")
    )
    # Stored, so that its size is known and a small one spares the payloads a shuffle.
    first = stored(first, "warc-copies")
    return (
        pages.join(
            first, (F.col("_digest") == F.col("_shared")) & (F.col("_bytes") >= min_bytes), "left"
        )
        .withColumn(
            "_refers_to", F.when(~F.col(page_id).eqNullSafe(F.col("_first")), F.col("_first"))
        )
        .drop("_shared", "_first")
    )


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("_id"),
        F.regexp_replace(F.col(url), r"[\x00-\x20]", "%20").alias("_url"),
        payload.alias("_payload"),
        base32_sha1(payload).alias("_digest"),
        F.octet_length(payload).cast("long").alias("_bytes"),
    )
    rows = with_roles(rows, "_id", "_payload", min_bytes)
    revisit = F.col("_refers_to").isNotNull()
    name = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("_url", F.concat(F.lit("urn:page:"), name)),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("_bytes").cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit(
                    "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/"
                    "identical-payload-digest\r\nWARC-Refers-To: <urn:page:"
                ),
                F.col("_refers_to").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    records = rows.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))
    records.write.option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(data: bytes, start: int) -> tuple[int, dict] | str:
    """The end and fields of the valid record at ``start``, or why there is none."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, start):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", start, start + HEADER_LIMIT)
    if head_end < 0:
        return "no end of header"
    fields = {}
    for line in data[start:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not MANDATORY <= fields.keys():
        return "mandatory header missing"
    length = fields["content-length"]
    if not re.fullmatch(r"\d{1,18}", length):
        return "bad content length"
    block_start = head_end + 4
    end = block_start + int(length)
    if end > len(data):
        return "truncated"
    if data[end : end + 4] != b"\r\n\r\n":
        return "content length does not end at a record end"
    block = data[block_start:end]
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    if kind != "revisit":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != found:
            return "payload digest differs"
        digest = found
    stated = fields.get("x-payload-length", "")
    return end + 4, {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_digest": digest or None,
        "payload_bytes": int(stated)
        if kind == "revisit" and stated.isdigit()
        else (None if kind == "revisit" else len(payload)),
        "payload": None if kind == "revisit" else payload,
    }


def _member(data: bytes, start: int) -> tuple[int, bytes] | None:
    """End and content of the valid gzip member at ``start``."""
    walker, at, parts = zlib.decompressobj(31), start, []
    try:
        while not walker.eof and at < len(data):
            parts.append(walker.decompress(data[at : at + HEADER_LIMIT]))
            at = min(at + HEADER_LIMIT, len(data))
    except zlib.error:
        return None
    return (at - len(walker.unused_data), b"".join(parts)) if walker.eof else None


def _found_at(data: bytes, at: int) -> tuple[int, Iterable[dict]] | str:
    """The end and rows of the valid record or gzip member at ``at``, or why there is none."""
    if data[at : at + 2] == GZIP[:2]:
        member = _member(data, at)
        if member is None:
            return "bad gzip member"
        end, content = member
        return end, (found | {"start": at, "end": end} for found in _walk(content, _record_at))
    return _record_at(data, at)


def _record_at(data: bytes, at: int) -> tuple[int, Iterable[dict]] | str:
    parsed = parse_record(data, at)
    if isinstance(parsed, str):
        return parsed
    end, fields = parsed
    return end, [{"kind": "record", "start": at, "end": end} | fields]


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive file, in file order.

    Offsets are bytes of the file; records of a gzip member carry the member's offsets.
    """
    return _walk(data, _found_at)


def _walk(data: bytes, found_at: Callable) -> Iterator[dict]:
    at, bad, why = 0, None, ""
    while at < len(data):
        found = found_at(data, at)
        # A search does not end at a gzip member without a record, which can be part of a payload.
        if bad is not None and not isinstance(found, str):
            rows = list(found[1])
            found = why if all(row["kind"] == "gap" for row in rows) else (found[0], rows)
        if isinstance(found, str):
            bad, why = (at, found) if bad is None else (bad, why)
            following = MARK.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield {"kind": "gap", "start": bad, "end": at, "reason": why}
            bad = None
        at, rows = found
        yield from rows
    if bad is not None:
        yield {"kind": "gap", "start": bad, "end": at, "reason": why}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archive files below ``path``."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in SCHEMA.split(", ")])
    rows_per_batch = 256

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, name = [], path.as_py()
                for found in salvage(content.as_py()):
                    found["path"] = name
                    if not with_payload:
                        found["payload"] = None
                    rows.append({column: found.get(column) for column in names})
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.mapInArrow(read, SCHEMA)
