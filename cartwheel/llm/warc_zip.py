"""WARC records in ZIP-packaged archives, read back by byte ranges.

Writing: equal payloads are found by digest; the first page of a digest is a ``response``
record, the others are ``revisit`` records that refer to it. Every archive is a ZIP file of
two stored members: the WARC file (one gzip member per record) and an index of the records'
offsets. Reading: the end of the file leads to the central directory (ZIP64 where the counts
or offsets need it), that to the stored members, and the index to each record's bytes; no
member is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.common import read_files, table, write_files
from cartwheel.session import scratch_path

ARCHIVE_BYTES = 16 << 20   # payload of an archive, about
REVISIT_BYTES = 0          # smaller payloads are always written in full
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2025-01-01T00:00:00Z"
# Fixed value: the profile of records that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Schemes whose files the workers read by range; others are read whole through Spark.
RANGE_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")


# ---- ZIP -------------------------------------------------------------------------------

class ZipArchive:
    """Directory of a ZIP file behind ``read_at(offset, length) -> bytes``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        tail = read_at(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # those bytes inside a comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            end = max(0, size - 65_557) + at
            sign, _, where = struct.unpack("<4sIQ", read_at(end - 20, 16))
            if sign != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = read_at(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read_at(start, length), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """name -> (method, stored bytes, offset of the local header)."""
        out, at = {}, 0
        for _ in range(count):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            where = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
            pos = 0
            while pos + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, pos)
                if kind == 1:  # ZIP64: the values that do not fit, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, pos + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    where = next(wide) if where == 0xFFFFFFFF else where
                pos += 4 + size
            out[name] = (method, packed, where)
            at += 46 + n_name + n_extra + n_comment
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        method, length, where = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; its records have no byte range")
        local = self.read_at(where, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return where + 30 + n_name + n_extra, length

    def records(self) -> Iterator[bytes]:
        """The records that the archive's index lists, each read by its range."""
        at, length = self.stored(INDEX)
        index = self.read_at(at, length).decode()
        start, _ = self.stored(DATA)
        for line in filter(None, index.split("\n")):
            entry = json.loads(line[line.index("{"):])
            yield gzip.decompress(self.read_at(start + entry["offset"], entry["length"]))


# ---- WARC ------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record with the headers alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id), "WARC-Date": DATE,
            "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|{}^`\"<>\\ "),
            "WARC-Payload-Digest": "sha1:" + digest(payload),
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Refers-To": _record_id(refers_to) if revisit else None,
            "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    kind, found = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != named or digest(payload) != found):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page, refers = (re.search(r"<urn:page:(-?\d*)>", fields.get(k, "<urn:page:>"))[1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {"page_id": int(page) if page else None, "payload_bytes": named, "payload_digest": found,
            "record_type": kind, "refers_to": int(refers) if refers else None,
            "payload": payload if kind == "response" else None}


def archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of (key, record) pairs, but for the newline the writer adds as its comment."""
    packed = [gzip.compress(r, 5, mtime=0) for _, r in records]
    index, at = [], 0
    for (key, _), data in zip(records, packed, strict=True):
        index.append(f"{key} {json.dumps({'offset': at, 'length': len(data)})}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), b"".join(packed))
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
        z.comment = b"\n"
    return out.getvalue()[:-1]


# ---- the Spark jobs --------------------------------------------------------------------

def write_archives(pages: DataFrame, path: str, *, revisit_bytes: int = REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for every row of ``pages`` (page_id, url, html), in archives below ``path``.

    A null html is an empty payload, a null url leaves the record without target. Of equal
    payloads of at least ``revisit_bytes`` bytes the smallest page_id is written in full; rows
    that repeat that page_id and payload are, too. A null page_id is never the first unless
    alone. Other columns are ignored.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = pages.select("page_id", F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"))
    firsts = key.where(F.col("n") >= revisit_bytes).groupBy("sha1", "n").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("pages"))
    firsts = firsts.where("pages > 1 AND refers_to IS NOT NULL").drop("pages")
    again = key.join(firsts, ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("id"), "sha1", "refers_to").distinct()
    full = pages.select("page_id", "url", "html", F.sha1(body).alias("own"))
    rows = full.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha1")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page, url, html, first in zip(*batch.columns, strict=True):
                page, first, payload = page.as_py(), first.as_py(), (html.as_py() or "").encode()
                held.append((str(page), record(page, url.as_py(), payload, first, first is not None)))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([archive(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"file": pa.array([archive(held)], pa.binary())})

    write_files(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file binary"), "file", path)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) per record.

    Only names and sizes of the files go through Spark where workers can read ranges.
    """
    ranged = (path.partition(":")[0] if ":/" in path else "file") in RANGE_SCHEMES
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * payloads
    schema += ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def rows(found: ZipArchive) -> pa.RecordBatch:
        out = [parse(r) for r in found.records()]
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in out], kinds.get(n, pa.string())) for n in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, size, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                if content is not None:
                    yield rows(ZipArchive(lambda at, n, data=content: data[at:at + n], size))
                    continue
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", where).replace("s3a:", "s3:"))
                with system.open_input_file(name) as f:
                    yield rows(ZipArchive(lambda at, n, f=f: f.read_at(n, at), size))

    files = read_files(spark, path)
    content = F.lit(None).cast("binary") if ranged else F.col("content")
    return files.select("path", "length", content.alias("content")).mapInArrow(run, schema)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k:
           (((instr('0123456789abcdef', substr(hex, 1 + (5 * i + k) // 4, 1)) - 1)
             >> (3 - (5 * i + k) % 4)) & 1) << (4 - k)))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""

QUERIES = {"op8_warc_zip": op8_warc_zip}
ORACLE_SQL = {"op8_warc_zip": OP8_SQL}
