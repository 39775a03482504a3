"""Operator 5: token ids in fixed-width bit-packed files, written in ascending document order and read back by range.

File: MAGIC; blocks of BLOCK_IDS ids, each id in the fewest bits that hold the vocabulary, each block padded to a byte; the footer with
block offsets, document ids (and which are null), and each document's first id in the file; a trailer of fixed size that locates the
footer. Any run of ids is read by seeking to its blocks and unpacking them with numpy.

Documents are range-partitioned by id once; each part becomes one file. Places in the whole corpus are sums over the table of files, one
row each, so no task and no driver sees more than its own part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permlens.llm import files
from permlens.llm.bpe import byte_symbols
from permlens.llm.common import LAST_ID, Aging, Out, bounded, kept, order_id, rows, text_of
from permlens.session import written

MAGIC = b"PLTOKEN1"
TRAILER = struct.Struct("<QQQQII8s")  # footer place, blocks, documents, ids, bits of an id, ids of a block, MAGIC
BLOCK_IDS = 1 << 15
CACHE_WORDS = 300_000
CACHE_PARTS = 200_000
BATCH_WORDS = 50_000
RUN_CHARS = 2 << 20
NO_ID = 0xFFFFFFFF
MARK = struct.pack("<I", NO_ID)
# Fixed value: the word pattern of the files whose texts may be encoded word by word; below it, the same for lower-case ASCII.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PARTS = regex.compile(KNOWN_PATTERN)
LAST_LEAD = 0xC8  # the first byte of U+0200 to U+023F in UTF-8; in words with a higher byte the library finds the parts itself
SYMBOLS = dict(enumerate(byte_symbols()))
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
READ_IDS = 1 << 20


class LibraryEncoder:
    """The tokenizers library over the distinct words of a task. Where the file's pattern parts texts at white space, a text's ids are its
    words' ids in order; a Latin word's ids are those of its normalized parts by that pattern. The new words of a run of texts are
    normalized and parted together; each part is encoded by the library's model, once while it is remembered; other words go through the
    library whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split == [KNOWN_PATTERN] and spec["post_processor"] is None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.model, self.normalizer = self.library.model, self.library.normalizer
        self.parts, self.words = Aging(CACHE_PARTS), Aging(CACHE_WORDS)

    def _library(self, data: bytes) -> bytes:
        ids = self.library.encode(data.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[bytes]) -> None:
        plain, latin = [], []
        for w in words:
            if b"<" in w or b"\x01" in w:  # a special token may begin so; the sign between words
                self.words[w] = self._library(w)
            elif w.isascii():
                plain.append(w)
            elif max(w) <= LAST_LEAD:
                latin.append(w)
            else:
                self.words[w] = self._library(w)
        for at in range(0, len(plain), BATCH_WORDS):
            some = plain[at : at + BATCH_WORDS]
            self._join(some, ASCII_PARTS.findall(b" \x01 ".join(some).lower()))
        for at in range(0, len(latin), BATCH_WORDS):
            some = latin[at : at + BATCH_WORDS]
            text = self.normalizer.normalize_str(b" \x01 ".join(some).decode())
            self._join(some, [p.encode() for p in LATIN_PARTS.findall(text)])

    def _join(self, words: list[bytes], parts: list[bytes]) -> None:
        """Parts of several words, with a mark between words, to ids by word. A part is in the stand-ins of its bytes, as the model takes it."""
        tokenize, known = self.model.tokenize, self.parts
        known[b"\x01"] = MARK
        for p in known.missing(set(parts)):
            ids = [t.id for t in tokenize(p.decode("latin-1").translate(SYMBOLS))]
            known[p] = struct.pack(f"<{len(ids)}I", *ids)
        data = b"".join(map(known.__getitem__, parts))
        ends = (np.flatnonzero(np.frombuffer(data, "<u4") == NO_ID) * 4).tolist()
        self.words.update(zip(words, [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True)], strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(self._library(t.encode()), "<u4") for t in texts]
        words = [t.encode().split() for t in texts]
        self._learn(self.words.missing(set().union(*words)))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, w)), "<u4") for w in words]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def encoder(path: str) -> LibraryEncoder:
    return kept(("token files", path), lambda: LibraryEncoder(path))


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class Writer:
    def __init__(self, sink, vocabulary: int) -> None:
        self.sink, self.width = sink, max(1, (max(vocabulary, 1) - 1).bit_length())
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.starts: list[int] = []
        self.open: list[np.ndarray] = []
        self.held = self.n = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held += len(ids)
        self.open.append(ids)
        if self.held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids, at = np.concatenate(self.open) if self.open else np.empty(0, "<u4"), 0
        while len(ids) - at >= BLOCK_IDS or last and at < len(ids):
            self.offsets.append(self.sink.tell())
            self.sink.write(pack(ids[at : at + BLOCK_IDS], self.width))
            at += BLOCK_IDS
        self.open, self.held = [ids[at:]], max(0, len(ids) - at)

    def close(self) -> None:
        self._blocks(True)
        footer = self.sink.tell()
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "<u1"), (self.starts, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(TRAILER.pack(footer, len(self.offsets), len(self.docs), self.n, self.width, BLOCK_IDS, MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file; only the footer is held."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - TRAILER.size)
        footer, blocks, docs, self.n, self.width, self.block_ids, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(footer)
        self.offsets = np.append(np.frombuffer(source.read(8 * blocks), "<u8"), np.uint64(footer))
        self.docs = np.frombuffer(source.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(source.read(docs), "<u1").astype(bool)
        self.starts = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids start .. start + count - 1 of the file, from the blocks that hold them."""
        if not count:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        at, held = 0, []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n - b * self.block_ids)
            size = int(self.offsets[b + 1] - self.offsets[b])
            held.append(unpack(data[at : at + size], self.width, n))
            at += size
        ids = held[0] if len(held) == 1 else np.concatenate(held)
        return ids[start - first * self.block_ids :][:count]


FILES = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write(docs: DataFrame, path: str, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encodes every document with the tokenizer file at `path`, appends `end_id`, writes the files and returns their table: part, path,
    n_docs, n_ids, start (ids in all files before). Documents follow in ascending (doc_id, text); a null text is empty; null ids come last.
    Repeated ids and rows are all written. An empty table writes no file."""
    folder = folder or files.shared_folder(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri, words = None, "", encoder(path)
        part = TaskContext.get().partitionId()
        for some in bounded(rows(batches, "doc_id", "text"), RUN_CHARS):
            if writer is None:
                uri, sink = files.create(folder, f"part-{part:06d}", "tok")
                writer = Writer(sink, max(words.size, (end_id or 0) + 1))
            for (doc_id, _), ids in zip(some, words.encode_all([t for _, t in some]), strict=True):
                writer.add(None if doc_id == LAST_ID else doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": uri, "n_docs": len(writer.docs), "n_ids": writer.n}], schema=FILES)

    ordered = docs.select(order_id().alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    table = written(ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "token-files-table")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return table.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(table: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (its first id's place in the corpus), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(DOCS)
        for path, before in rows(batches, "path", "start"):
            with files.open_random(path) as source:
                reader = Reader(source)
                ends = np.append(reader.starts[1:], reader.n)
                low, held = 0, np.empty(0, np.uint32)  # a window of ids, moved on as documents are read
                for doc_id, null, start, end in zip(reader.docs.tolist(), reader.nulls.tolist(), reader.starts.tolist(), ends.tolist(), strict=True):
                    if end > low + len(held):
                        low, held = start, reader.ids(start, min(max(end - start, READ_IDS), reader.n - start))
                    crc = zlib.crc32(held[start - low : end - low].astype("<u4").tobytes())
                    if out.add(None if null else doc_id, before + start, end - start, crc):
                        yield out.take()
        yield from out.rest()

    spread = table.select("path", "start").repartition(max(1, table.count()))  # one file, one task
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
