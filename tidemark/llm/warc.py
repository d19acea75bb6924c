"""WARC archives: written as gzip members, one a record, and read back by byte ranges.

The reader is splittable: an archive is cut into ranges, a task scans its range for the gzip
magic, takes a place for the beginning of a member only if the header's flags hold, the whole
member decodes with the right checksum to a WARC record of the stated length, and another
member or the end of the file follows (or the file begins there), and owns the records that begin inside its range.
From the first one on members follow each other without a scan.

Files are reached through ``pyarrow.fs``, by the scheme of their path.  A task names its
archives with its own attempt, and only those that a finished task reports are read, so what
a lost executor leaves behind is no part of the result.
"""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator
from hashlib import sha1
from typing import BinaryIO
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Fixed values of the formats.
MAGIC, VERSION, PROFILE = b"\x1f\x8b\x08", b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESERVED_FLAGS = 0xE0
EPOCH = "1970-01-01T00:00:00Z"

ARCHIVE_BYTES = 1 << 28  # an archive is closed when it is so long
RANGE_BYTES = 1 << 25  # of an archive that a task scans at a time
CHUNK = 1 << 18  # bytes read at a time
HEADERS = 1 << 20  # a record whose header is longer is none
SALT_FROM = 1000  # payloads that more than one page in so many has are looked up without a shuffle

MANIFEST = "path string, bytes bigint, records bigint"
RECORD = "path string, offset bigint, length bigint, type string, record_id string, target_uri string, refers_to string, date string, payload_digest string, payload_bytes bigint, payload binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest_of(payload: bytes) -> str:
    """The payload's SHA-1 in upper-case base 32."""
    return b32encode(sha1(payload).digest()).decode()


def base32_sha1(payload: Column) -> Column:
    """The same as a Column: four groups of ten hex digits are eight base-32 digits each."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: int | str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = EPOCH) -> bytes:
    """A response, or a revisit of the response ``refers_to``, which holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member without a name or time, so that equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parsed(content: bytes) -> dict[str, str] | None:
    """The header fields of a record that is whole, else None."""
    end = content.find(b"\r\n\r\n", 0, HEADERS)
    if end < 0 or not content.startswith(b"WARC/1."):
        return None
    fields = fields_of(content[:end])
    length = fields.get("content-length", "")
    return fields if length.isdigit() and content[end + 4 + int(length) :] == b"\r\n\r\n" else None


def row_of(content: bytes, fields: dict[str, str]) -> tuple:
    """``type`` to ``payload`` of ``RECORD``.  The digest is that of the payload that was read; one that is not as stated is an error."""
    begin = content.index(b"\r\n\r\n") + 4
    block = content[begin : begin + int(fields["content-length"])]
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    kind, payload, size = fields.get("warc-type"), block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = fields_of(http).get("content-length", "")
        size = int(length) if length.isdigit() else len(payload)
    if kind == "revisit":
        payload, digest = None, stated
    else:
        digest, size = digest_of(payload), len(payload)
        if stated and stated != digest:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload's digest is {digest}, stated is {stated}")
    return kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-date"), digest, size, payload


class Archive:
    """Members of an open file, found and decoded by position."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size

    def bytes_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(self.size - at, 0)))

    def begins(self, at: int) -> bool:
        head = self.bytes_at(at, 4)
        return len(head) == 4 and head.startswith(MAGIC) and not head[3] & RESERVED_FLAGS

    def member(self, at: int) -> tuple[bytes, int] | None:
        """A member's content and its end; None if no whole member with the right checksum begins there or its content is no record's beginning."""
        if not self.begins(at):
            return None
        unpacker, out, place = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                chunk = self.bytes_at(place, CHUNK)
                if not chunk:
                    return None
                place += len(chunk)
                out.append(unpacker.decompress(chunk))
                if len(out) == 1 and len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                    return None  # a place that only looks like a member is given up at its first bytes
        except zlib.error:
            return None
        return b"".join(out), place - len(unpacker.unused_data)

    def first(self, begin: int, end: int) -> int | None:
        """Where the first member in a range begins; None without one."""
        at = begin
        while at < end:
            window = self.bytes_at(at, CHUNK + len(MAGIC) - 1)  # a magic across two windows is seen by the first
            found = window.find(MAGIC)
            while 0 <= found < CHUNK and at + found < end:
                if (whole := self.member(at + found)) and parsed(whole[0]) and (at + found == 0 or whole[1] == self.size or self.begins(whole[1])):
                    return at + found
                found = window.find(MAGIC, found + 1)
            at += CHUNK
        return None

    def records(self, begin: int, end: int) -> Iterator[tuple[int, int, bytes, dict[str, str]]]:
        """Offset, length, content and fields of the records that begin in a range."""
        at = self.first(begin, end)
        while at is not None and at < end:
            whole = self.member(at)
            fields = parsed(whole[0]) if whole else None
            if fields is None:  # something else lies between members
                at = self.first(at + 1, end)
                continue
            yield at, whole[1] - at, whole[0], fields
            at = whole[1]


def with_targets(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with ``payload``, ``digest`` and ``refers_to``: of an equal payload the smallest ``page_id``, null on the pages that have it themselves.

    Payloads are equal if length, SHA-256 and SHA-1 are.  A payload of more than one page in ``SALT_FROM``
    is one of fewer than so many and looked up by broadcast; the others are joined by shuffle, where none is large.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("_same", F.sha2("payload", 256)).withColumn("_n", F.octet_length("payload"))
    counted = rows.groupBy("_same", "digest", "_n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
    groups = materialise(counted, "warc-payloads")
    total = groups.agg(F.sum("pages")).first()[0] or 0
    several = groups.where(F.col("pages") > 1).where(F.col("_n") >= min_bytes).select("_same", "digest", "_n", "first", "pages")
    common = F.broadcast(several.where(F.col("pages") * SALT_FROM > total).drop("pages"))
    rare = several.where(F.col("pages") * SALT_FROM <= total).drop("pages")
    on = ["_same", "digest", "_n"]
    found = rows.join(common, on).unionByName(rows.join(common, on, "left_anti").join(rare, on, "left"), allowMissingColumns=True)
    return found.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES, date: str = EPOCH) -> DataFrame:
    """Write a record for each row (``page_id`` long, ``url``, ``html``) into archives in ``folder``; returns their ``path``, ``bytes`` and ``records``.

    Of equal payloads of at least ``min_bytes`` the row with the smallest id is a response and the
    others revisit it; smaller ones are all responses.  A null payload is empty, a null url is left
    out, other characters than a URI's are percent-encoded.  Rows that repeat the smallest id are
    responses all of them; rows without an id revisit the smallest one, or are responses if
    there is none.  An empty table gives no archives.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, size, count = f"{root.rstrip('/')}/{uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(name, compression=None)
                packed = member(record(page_id, url, payload, digest, refers_to, date), level)
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        base = folder.rstrip("/")
        rows = [(f"{base}/{n.rpartition('/')[2]}", s, c) for n, s, c in done]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.string(), pa.int64(), pa.int64()])], names=["path", "bytes", "records"])

    typed = with_targets(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), min_bytes)
    return materialise(typed.mapInArrow(run, MANIFEST), "warc-manifest")


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) of archives (``path``, ``bytes``), whatever wrote them; without ``payloads`` these stay null but are checked all the same.

    A response's digest is computed from its payload, a revisit's is the stated one, its
    ``payload_bytes`` those of its HTTP header.  What is no member is passed over.  A payload that holds two
    whole stored members in a row, followed by each other, could be taken for records where a range begins inside it.
    """
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("begin"))
    ranges = ranges.repartition("path", "begin")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = opened(path)
                with system.open_input_file(at) as file:
                    rows, held = [], 0
                    for offset, length, content, fields in Archive(file, size).records(begin, min(begin + range_bytes, size)):
                        *known, payload = row_of(content, fields)
                        rows.append((path, offset, length, *known, payload if payloads else None))
                        held += len(content)
                        if held >= 1 << 24 or len(rows) >= 10_000:
                            yield as_batch(rows)
                            rows, held = [], 0
                    yield as_batch(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return ranges.mapInArrow(run, RECORD)


def page_of(identifier: Column) -> Column:
    """The page's id in a record id that ``write`` made."""
    return F.regexp_extract(identifier, "^<urn:x-page:(-?[0-9]*)>$", 1).try_cast("bigint")

