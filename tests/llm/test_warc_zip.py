import io
import zipfile

import pytest

from cartwheel.llm import warc_zip
from cartwheel.llm.warc_zip import ZipArchive, archive, digest, parse, read_archives, record, write_archives
from cartwheel.session import scratch_path

PAGES = "page_id long, url string, html string"


def _open(data):
    return ZipArchive(lambda at, n: data[at:at + n], len(data))


def test_zip64_directories_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):  # more than a plain directory can count
            z.writestr(zipfile.ZipInfo(f"e{i}"), b"")
        with z.open("large", "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is only a comment"
    data = out.getvalue()
    found = _open(data)
    at, n = found.stored("large")
    assert len(found.members) == 66_002 and data[at:at + n] == b"stored bytes"
    with pytest.raises(ValueError, match="compressed"):
        found.stored("packed")


def test_zip64_sizes_in_the_extra_field():
    import struct
    extra = struct.pack("<HHQQQ", 1, 24, 5, 7, 1 << 33)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    assert ZipArchive._directory(entry + b"n" + extra, 1) == {"n": (0, 7, 1 << 33)}


def test_broken_files_are_refused():
    good = archive([("1", record(1, "http://a", b"x", None, False))]) + b"\n"
    assert zipfile.ZipFile(io.BytesIO(good)).testzip() is None
    for bad in (b"", b"no zip", good[:-30]):
        with pytest.raises(ValueError):
            _open(bad)
    with pytest.raises(ValueError, match="digest"):
        parse(record(1, None, b"payload", None, False).replace(b"payload", b"PAYLOAD"))


def _write_and_read(spark, rows, partitions=3, **options):
    path = scratch_path(spark, "test-archives")
    write_archives(rows.repartition(partitions), path, **options)
    return path, sorted((tuple(r) for r in read_archives(spark, path, payloads=True).collect()), key=repr)


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        refers = first.get(html or "")
        refers = None if refers == page or len([1 for r in rows if (r[2] or "") == (html or "")]) < 2 else refers
        out.append((page, len(body), digest(body), "response" if refers is None else "revisit", refers, body if refers is None else None))
    return sorted(out, key=repr)


def test_round_trip(spark, make):
    rows = [(i, f"http://h/{i}", f"<p>é {i % 7}</p>" * (i % 4)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x/\r\nInjected: 1", ""), (102, "", "\r\n\r\nContent-Length: 3\r\n\r\n"), (103, "u", "z" * 200_000),
             (5, "http://h/5", "<p>é 5</p>"), (None, "u", "<p>é 5</p>"), (None, "v", "alone")]
    for least in (0, 15):
        assert _write_and_read(spark, make(rows, PAGES), revisit_bytes=least, archive_bytes=500)[1] == brute(rows, least)
    assert _write_and_read(spark, make([], PAGES))[1] == []


def test_without_range_reads(spark, make, monkeypatch):
    rows = [(i, "u", f"text {i % 3}") for i in range(9)]
    path, got = _write_and_read(spark, make(rows, PAGES))
    monkeypatch.setattr(warc_zip, "RANGE_SCHEMES", ())
    assert sorted((tuple(r) for r in read_archives(spark, path, payloads=True).collect()), key=repr) == got == brute(rows)
