import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from permlens.llm import files, warc
from tests.llm.conftest import key, rows_of

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        low = first.get(h or "")
        again = len(p) >= 100 and low is not None and (i is None or i > low)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>copied é</p>" * 20, "<p>alone</p>" * 30
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "u", "x" * 300_000), (0, "ü", "\r\n\r\nWARC/1.1\r\n" * 9), (0, "u", other)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)


def test_odd_pages_equal_brute_force(pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert rows_of(warc.read(warc.write(pages)), *COLUMNS) == brute(rows)
    small = warc.write(pages, archive_bytes=200)
    assert small.count() > 3 and rows_of(warc.read(small), *COLUMNS) == brute(rows)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_payloads_come_back_whole(pages):
    got = {(r.page_id, r.payload) for r in warc.read(warc.write(pages), payload=True).collect() if r.record_type == "response"}
    assert got <= {(r.page_id, (r.html or "").encode()) for r in pages.collect()} and (9, b"x" * 300_000) in got


@pytest.mark.parametrize("limit", [None, 50, 5])
def test_directories_of_any_kind_are_read_by_range(monkeypatch, limit):
    """limit: from which size the writer uses ZIP64 fields."""
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        with z.open("archive/ä.warc", "w", force_zip64=bool(limit)) as m:
            m.write(b"0123456789" * 40)
        z.writestr("packed", "z" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    archive = warc.ZipRanges(pa.BufferReader(data.getvalue()))
    assert set(archive.members) == {"datapackage.json", "archive/ä.warc"}
    assert archive.read("archive/ä.warc", 8, 4) == b"8901" and archive.read("datapackage.json") == b"{}"
    with pytest.raises(ValueError):
        archive.read("archive/ä.warc", 399, 2)
    with pytest.raises(ValueError):
        warc.ZipRanges(pa.BufferReader(data.getvalue()[:-30]))


def test_other_tools_read_the_archives(pages):
    for a in warc.write(pages).collect():
        with files.open_random(a.path) as f, zipfile.ZipFile(f) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.WARC_MEMBER, warc.INDEX_MEMBER}
