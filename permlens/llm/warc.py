"""Operator 2: WARC records in ZIP-packaged archives, and a reader that finds and reads them by range.

An archive is a ZIP file with stored members: archive/data.warc.gz, in which every record is a gzip member of its own, as WARC files are
kept, and indexes/index.cdxj, one JSON line per record with its offset and length in the WARC member. The reader never extracts: it reads the end of the file, follows the ZIP64 locator where there is
one, parses the central directory, finds where the stored members' bytes begin from their local headers, reads the index and then each
record by its range.

Copies: of records with equal payloads of at least MIN_REVISIT bytes the smallest id is the response and the others become revisits that
refer to it. The decision joins ids and digests only; payloads move at most once, by id, so a group of copies of any size is no one
task's work. Archives are closed at ARCHIVE_BYTES.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.llm import files
from permlens.llm.common import Out, rows
from permlens.session import written

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
GZIP_LEVEL = 3
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures and layouts of the end record, the ZIP64 locator and end record, directory and local headers.
END, END_SIG = struct.Struct("<4sHHHHIIH"), b"PK\x05\x06"
LOCATOR, LOCATOR_SIG = struct.Struct("<4sIQI"), b"PK\x06\x07"
END64, END64_SIG = struct.Struct("<4sQHHIIQQQQ"), b"PK\x06\x06"
ENTRY, ENTRY_SIG = struct.Struct("<4sHHHHHHIIIHHHHHII"), b"PK\x01\x02"
LOCAL, LOCAL_SIG = struct.Struct("<4sHHHHHIIIHH"), b"PK\x03\x04"
ZIP64_EXTRA, FULL16, FULL32, STORED = 1, 0xFFFF, 0xFFFFFFFF, 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Reading ZIP archives by range


class Member:
    def __init__(self, name: str, start: int, size: int) -> None:
        self.name, self.start, self.size = name, start, size


class ZipRanges:
    """The stored members of a ZIP archive as byte ranges of the file."""

    def __init__(self, source) -> None:
        self.source = source
        self.size = source.size()
        count, size, start = self._end()
        self.members = self._directory(self._at(start, size), count)

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and place of the central directory."""
        tail_at = max(0, self.size - END.size - FULL16)
        tail = self._at(tail_at, self.size - tail_at)
        at = tail.rfind(END_SIG, 0, len(tail) - END.size + len(END_SIG))
        while at >= 0 and at + END.size + END.unpack_from(tail, at)[7] != len(tail):  # the signature may also occur in the comment
            at = tail.rfind(END_SIG, 0, at + len(END_SIG) - 1)
        if at < 0:
            raise ValueError("no end of central directory: not a whole ZIP archive")
        _, _, _, _, count, size, start, _ = END.unpack_from(tail, at)
        locator_at = tail_at + at - LOCATOR.size
        if locator_at >= 0 and (FULL16 in (count,) or FULL32 in (size, start)):
            sig, _, end64_at, _ = LOCATOR.unpack(self._at(locator_at, LOCATOR.size))
            if sig == LOCATOR_SIG:
                sig, *_, count, size, start = END64.unpack(self._at(end64_at, END64.size))
                if sig != END64_SIG:
                    raise ValueError("broken ZIP64 end record")
        return count, size, start

    def _directory(self, data: bytes, count: int) -> dict[str, Member]:
        members, at = {}, 0
        for _ in range(count):
            sig, _, _, flags, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, local = ENTRY.unpack_from(data, at)
            if sig != ENTRY_SIG:
                raise ValueError("broken central directory")
            name = data[at + ENTRY.size :][:n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + ENTRY.size + n_name :][:n_extra]
            if FULL32 in (packed, size, local):
                size, packed, local = self._wide(extra, size, packed, local)
            at += ENTRY.size + n_name + n_extra + n_comment
            if method != STORED or packed != size:
                continue  # packed members hold no byte ranges of records
            sig, *_, n_name, n_extra = LOCAL.unpack(self._at(local, LOCAL.size))
            if sig != LOCAL_SIG:
                raise ValueError("broken local header")
            members[name] = Member(name, local + LOCAL.size + n_name + n_extra, size)
        return members

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, local: int) -> list[int]:
        """The ZIP64 extra field holds, in this order, only those values that are full in the entry."""
        at, values = 0, [size, packed, local]
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_EXTRA:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                return [next(wide) if v == FULL32 else v for v in values]
            at += 4 + length
        return values

    def read(self, member: str, start: int = 0, size: int | None = None) -> bytes:
        m = self.members[member]
        if start < 0 or start + (size or 0) > m.size:
            raise ValueError("range outside of the member")
        return self._at(m.start + start, m.size - start if size is None else size)


# WARC records


def record(kind: str, record_id: str, uri: str | None, digest: str, length: int, payload: bytes, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only; the payload's length stands in the HTTP header of both."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": EPOCH, "WARC-Payload-Digest": f"sha256:{digest}"}
    if uri is not None:
        head["WARC-Target-URI"] = _line(uri)
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))} | (extra or {})
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


EPOCH = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # the pages carry no time; equal input gives equal records


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")
    if not lines[0].startswith(("WARC/", "HTTP/")):
        raise ValueError("not a record")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest[:32]}"


# Spark jobs


class Archive:
    """One archive being written: records go out at once; only the index lines are held."""

    def __init__(self, folder: str, stem: str) -> None:
        self.path, self.sink = files.create(folder, stem, "wacz")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.warc = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (2000, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes, **entry) -> None:
        data = gzip.compress(data, GZIP_LEVEL, mtime=0)
        self.lines.append(json.dumps(entry | {"offset": self.size, "length": len(data)}))
        self.warc.write(data)
        self.size += len(data)

    def close(self) -> dict:
        self.warc.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER, (2000, 1, 1, 0, 0, 0)), "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return {"path": self.path, "n_records": len(self.lines), "n_bytes": self.size}


ARCHIVES = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the smallest id with this payload, where that is another one and the payload is long
    enough). A null id comes after all others. Rows that repeat an id and a payload are of one type."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    named = full.where(F.length("payload") >= MIN_REVISIT).select("page_id", "digest")
    first = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copies = named.join(first, "digest").where("page_id is null or page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    same = F.col("p.page_id").eqNullSafe(F.col("c.page_id")) & (F.col("p.digest") == F.col("c.digest"))
    return full.alias("p").join(copies.alias("c"), same, "left").select("p.page_id", "p.url", "p.payload", "p.digest", "c.refers_to")


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and returns the table of archives: path, n_records, n_bytes. A null html is an
    empty payload; null urls have no target URI; other columns are not written; no rows give no archive."""
    folder = folder or files.shared_folder(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done, part = None, [], TaskContext.get().partitionId()
        for page_id, url, payload, digest, refers_to in rows(batches, "page_id", "url", "payload", "digest", "refers_to"):
            archive = archive or Archive(folder, f"part-{part:06d}-{len(done):04d}")
            kind = "response" if refers_to is None else "revisit"
            target = None if refers_to is None else record_name(refers_to, digest)
            data = record(kind, record_name(page_id, digest), url, digest, len(payload), payload, target)
            archive.add(data, page_id=page_id, digest=digest, type=kind)
            if archive.size >= archive_bytes:
                done.append(archive.close())
                archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=ARCHIVES)

    return written(with_revisits(pages).mapInArrow(run, "path string, n_records long, n_bytes long"), "archives-table")


RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload where it is asked for (of
    responses; a revisit has none of its own). The digest of a response is computed anew and must agree with its header."""
    schema = RECORDS if payload else pa.schema(list(RECORDS)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for (path,) in rows(batches, "path"):
            with files.open_random(path) as source:
                archive = ZipRanges(source)
                for line in archive.read(INDEX_MEMBER).splitlines():
                    entry = json.loads(line)
                    values = _row(gzip.decompress(archive.read(WARC_MEMBER, entry["offset"], entry["length"])), entry)
                    if out.add(*values[: len(schema)], weight=len(values[-1] or b"") if payload else 0):
                        yield out.take()
        yield from out.rest()

    spread = archives.select("path").repartition(max(1, archives.count()))  # one archive, one task
    return spread.mapInArrow(run, ", ".join(f"{f.name} {KINDS[str(f.type)]}" for f in schema))


KINDS = {"int64": "long", "string": "string", "binary": "binary"}


def _row(data: bytes, entry: dict) -> tuple:
    warc, http, payload = parse(data)
    digest, length, kind = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), warc["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {warc['warc-record-id']} does not hold its payload")
    refers_to = int(warc["warc-refers-to"].strip("<>").split(":")[2]) if kind == "revisit" else None
    return entry["page_id"], warc.get("warc-target-uri"), length, digest, kind, refers_to, payload if kind == "response" else None
