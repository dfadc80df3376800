"""Web archives: a writer, and a reader that salvages what is whole.

Records are written by Spark's text sink with the record separator as line end, so an
archive is a plain file in any store that Spark writes to. The reader takes plain
archives and such with gzip members. It checks the version line, the header, the
declared length, the separator and the block digest. Where a check fails it looks
for the next version line or gzip member that passes all of them, goes on from there
and logs the bytes in between as a quarantined gap.

* A page with a null html has an empty payload; equal payloads, empty ones included,
  are one response and revisits of it. Rows that share the smallest id of a payload are
  all responses. A null id is written as ``-`` and read as null; it refers to and is
  referred to like any other, and is never the smallest unless all are null.
* A null url has no target line; white space in urls is escaped.
* No pages give no record; an empty archive has neither records nor gaps. Other columns are not read.
* A file is read by one task: ``RECORDS`` bounds the size of those written here.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise, new_path

#: Records of a file at most.
RECORDS = 2000
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shortest payload that is written once only.
LEAST_PAYLOAD = 0

_URN = "urn:page:"
_BREAK = b"\r\n\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")
_STEP = 1 << 16


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string value: 5 hex digits are 4 digits of 5 bits."""
    hexed = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``page_id`` and ``refers_to`` of the pages whose payload a page with a smaller id has.

    Payloads are compared by digest and size. Pages with a null id are left out
    unless another page has their payload.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    marked = materialise(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")), "payloads")
    shared = materialise(marked.where(F.col("size") >= least).groupBy("digest", "size")
                         .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared_payloads")
    return (marked.join(shared, ["digest", "size"])
            .where("refers_to IS NOT NULL AND (page_id IS NULL OR page_id != refers_to)").select("page_id", "digest", "refers_to"))


def records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``record``: the whole record of each page but for the separator after it."""
    seen = materialise(revisits(pages, least).distinct(), "revisits").select(
        F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.join(seen, F.col("page_id").eqNullSafe(F.col("revisit_id"))
                     & (F.sha1(F.col("html").cast("binary")) == F.col("revisit_digest")), "left")
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
                    F.octet_length("html").cast("string"), F.lit(line * 2))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.concat(http, "html"))
    target = F.regexp_replace("url", r"[\s\x00-\x1f]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
        F.lit(f">{line}WARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), target), F.lit("")),
        F.when(again, F.concat(F.lit(f"{line}WARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"),
                               F.lit(f">{line}WARC-Profile: {REVISIT_PROFILE}"))).otherwise(F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html").cast("binary")),
        F.lit(f"{line}WARC-Block-Digest: sha1:"), base32_sha1(F.col("block").cast("binary")),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length("block").cast("string"), F.lit(line * 2), F.col("block"))
    return rows.withColumn("block", block).select(head.alias("record"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> None:
    """Write the pages as archives of at most ``RECORDS`` records to ``folder``."""
    (records(pages, least).write.option("lineSep", _BREAK.decode()).option("maxRecordsPerFile", RECORDS)
     .text(folder))


def _digest(octets: bytes) -> str:
    return base64.b32encode(hashlib.sha1(octets).digest()).decode()


def _plain(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record that starts at ``at``: where it ends, its fields and block; or what is wrong with it."""
    line = data[at:at + 10]
    if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
        return "no version line"
    head_end = data.find(_BREAK, at + 8)
    if head_end < 0:
        return "header without end"
    fields = {}
    for raw in data[at + 10:head_end].split(b"\r\n"):
        field = _FIELD.fullmatch(raw)
        if not field:
            return "bad header line"
        fields[field[1].decode().lower()] = field[2].decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return "no length or type"
    start = head_end + 4
    end = start + int(fields["content-length"])
    if end > len(data):
        return "shorter than its length"
    if data[end:end + 4] != _BREAK:
        return "no separator after the block"
    block = data[start:end]
    digest = fields.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest[5:] != _digest(block):
        return "wrong block digest"
    return end + 4, fields, block


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What could be inflated of the gzip member at ``at``, where the inflater stopped, and what is wrong with the member."""
    inflate = zlib.decompressobj(wbits=31)
    parts, pos = [], at
    while not inflate.eof:
        if pos >= len(data):
            return b"".join(parts), len(data), "member without end"
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(data[pos:pos + _STEP]))
        except zlib.error:
            i = pos
            try:
                while True:
                    parts.append(before.decompress(data[i:i + 1]))
                    i += 1
            except zlib.error:
                return b"".join(parts), i + 1, "bad gzip member"
        pos += _STEP
    return b"".join(parts), min(pos, len(data)) - len(inflate.unused_data), None


def _stored_as(octets: bytes, record: bytes) -> bool:
    """Whether ``octets`` are a record, or one with the five bytes that begin a stored block of deflate in its header."""
    if octets == record:
        return True
    same = next((i for i, (a, b) in enumerate(zip(octets, record, strict=False)) if a != b), len(record))
    return len(octets) == len(record) + 5 and any(octets[:i] + octets[i + 5:] == record for i in range(max(0, same - 5), same + 1))


def _inner(content: bytes) -> tuple[list[tuple[dict[str, str], bytes, bytes]], list[tuple[int, int, str]]]:
    """Whole records of an inflated member (fields, block, all bytes), and the gaps between them: start, length, what is wrong."""
    at, gap, reason, found, gaps = 0, None, "", [], []
    while at < len(content):
        record = _plain(content, at)
        if isinstance(record, str):
            if gap is None:
                gap, reason = at, record
            following = _VERSION.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        if gap is not None:
            gaps.append((gap, at - gap, reason))
            gap = None
        found.append((*record[1:], content[at:record[0]]))
        at = record[0]
    if gap is not None:
        gaps.append((gap, len(content) - gap, reason))
    return found, gaps


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """Records and gaps of an archive in order: start, length, fields, block, and what was wrong with a gap.

    Whole records of a damaged gzip member start at the member and have length 0, since its bytes are
    a gap. A gap inside a whole member has length 0 too and says where it is in the inflated bytes.

    A member that was stored and not packed shows its records in the archive's bytes too. Such a record is not returned
    twice: it begins where the inflater has read, and its bytes are those of a record that came out of there.
    """
    at, gap, reason = 0, None, None
    taken, read_to = [], 0
    while at < len(data):
        found, inner, wrong, end = [], [], None, at
        if data[at:at + 3] == b"\x1f\x8b\x08":
            content, end, wrong = _inflated(data, at)
            found, inner = _inner(content)
            if wrong is None and content and not found:
                wrong = f"{inner[0][2]} in a gzip member"
        else:
            got = _plain(data, at)
            if isinstance(got, str):
                wrong = got
            else:
                end, found = got[0], [(*got[1:], data[at:got[0]])]
        if wrong is not None:
            if gap is None:
                gap, reason = at, wrong
            if end > read_to:
                read_to = end
            for fields, block, octets in found:
                taken.append(octets)
                yield at, 0, fields, block, None
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if data[at:at + 1] == b"W" and at < read_to:
            twin = next((i for i, record in enumerate(taken) if _stored_as(found[0][2], record)), None)
            if twin is not None:
                del taken[twin]
                at = end
                continue
        if gap is not None:
            yield gap, at - gap, None, None, reason
            gap = None
        if at >= read_to:
            taken = []
        for fields, block, _ in found:
            yield at, end - at, fields, block, None
        for start, length, what in inner:
            yield at, 0, None, None, f"{what}, {length} bytes at {start} in a gzip member"
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, None, reason


_READ = ("path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, "
         "refers_to string, declared_digest string, payload_bytes long, payload_digest string")


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header, where it has one."""
    if fields.get("content-type", "").startswith("application/http") and _BREAK in block:
        return block[block.index(_BREAK) + 4:]
    return block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each record and each gap of the archives in ``folder``.

    ``payload_bytes`` and ``payload_digest`` are those of the payload that was read; a
    revisit has none. ``gap`` says what was wrong with the first bytes of a gap.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for start, length, fields, block, wrong in salvage(content):
                    if fields is None:
                        rows.append((path, start, length, wrong, *[None] * (8 if with_payload else 7)))
                        continue
                    kind = fields["warc-type"]
                    payload = None if kind == "revisit" else payload_of(fields, block)
                    rows.append((path, start, length, None, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                                 fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 None if payload is None else len(payload), None if payload is None else _digest(payload),
                                 *[payload] * with_payload))
                names = [part.split()[0] for part in schema.split(", ")]
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    schema = _READ + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(read, schema)


def page_records(found: DataFrame, id_type: str = "long") -> DataFrame:
    """What was read, by page; a revisit has the size of the payload that it refers to."""
    page = F.regexp_extract("record_id", f"<{_URN}([^>]*)>", 1)
    record = found.where("gap IS NULL").select(
        F.when(page != "-", page).cast(id_type).alias("page_id"), "record_id", "record_type", "payload_bytes",
        F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        F.when(F.col("refers_to").isNotNull(), F.regexp_extract("refers_to", f"<{_URN}([^>]*)>", 1)).cast(id_type).alias("refers_to"))
    record = materialise(record, "records")
    whole = record.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = record.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = materialise(record.where("record_type = 'response'").groupBy("page_id", "payload_digest")
                        .agg(F.max("payload_bytes").alias("payload_bytes")), "payload_sizes").select(
        F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), "payload_bytes")
    sized = again.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return whole.unionByName(sized.select(*whole.columns))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the scratch folder and read them back."""
    folder = new_path(pages.sparkSession, "archives")
    write_archives(pages.select("page_id", "url", "html"), folder)
    return page_records(read_archives(pages.sparkSession, folder), pages.schema["page_id"].dataType.simpleString())
