"""Operator 3: removal of passages that another document already has, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of its MINI-word sequences, so equal windows have equal
minimisers. Consecutive windows of a text that share a minimiser travel as one packed string to the minimiser's bucket, where the windows
of its strings are counted exactly, word for word.

1. A narrow pass finds the smallest and largest document of every minimiser: one of a single document cannot hold a repeat. The others set
   bits of a filter of bounded size; it only spares work, as what passes it wrongly is counted like the rest.
2. A second pass writes the packed strings of minimisers that pass, each once per chunk of documents however many copies the chunk has,
   and the places of all. The few minimisers with very many different strings (an edge of a passage that a third of the corpus quotes)
   send every window on its own, to a bucket named by the window's hash, so that no bucket is one task's burden. Their threshold
   follows from the corpus so that at most MAX_HOT are named.
3. Each bucket yields, for its strings, the smallest document of every window, and a join by the string's digest brings that to all places
   where it occurs.
4. Every document meets the ranges found in it once, by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from permlens.llm.common import LAST_ID, Out, WordNumbers, hidden, mix, order_id, packed_table, rows, text_of, words_of

WINDOW = 50
MINI = 10
RUN_WINDOWS = 64  # a longer run with one minimiser is cut; its parts go to the same bucket
CHUNK_WORDS = 500_000
HOT_STRINGS = 1_000
MAX_HOT = 1_000_000
FILTER_BITS = (16, 27)  # fewest and most, as powers of two: at most 16 MB
BLOCK_BITS = 4096 * 8
RANGES = hidden("ranges")


def minimisers(numbers: np.ndarray, window: int, mini: int) -> np.ndarray:
    """The minimiser of the window that starts at each word, given the words' hashes."""
    count = len(numbers) - window + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    least = np.zeros(len(numbers) - mini + 1, np.uint64)
    for i in range(mini):
        least = least * base + numbers[i : i + len(least)]
    least = mix(least)
    width, span = window - mini + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    return least


def word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[list[bytes]]]]:
    """Runs of documents with a bounded number of words together: their (doc, row) and words."""
    ids, texts, size = [], [], 0
    for doc, row, text in rows(batches, "doc", "row", "text"):
        words = words_of(text)
        if ids and size + len(words) > CHUNK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append((doc, row))
        texts.append(words)
        size += len(words)
    if ids:
        yield ids, texts


def runs(texts: list[list[bytes]], numbers: WordNumbers, window: int, mini: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts together: text, first window, windows and minimiser of every run of windows with one minimiser."""
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    least = minimisers(numbers([w for t in texts for w in t]), window, mini)
    counts = np.maximum(lengths - window + 1, 0)
    of = np.repeat(np.arange(len(texts)), counts)
    if not len(of):
        return of, of, of, np.empty(0, np.uint64)
    first = np.cumsum(counts) - counts
    place = np.arange(len(of)) - first[of]
    least = least[starts[of] + place]  # only windows inside one text
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])]))
    run_of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(of))))
    cut = np.flatnonzero((np.arange(len(of)) - new[run_of]) % RUN_WINDOWS == 0)
    return of[cut], place[cut], np.diff(np.append(cut, len(of))), least[cut]


def _identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(order_id(id_column).alias("doc"), F.xxhash64(text_of(text_column)).alias("row"), text_of(text_column).alias("text"))


def run_hashes(texts: list[list[bytes]], numbers: WordNumbers, of: np.ndarray, place: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the words of every run, from sums over the words' hashes times powers of an odd number and its inverse."""
    words = numbers([w for t in texts for w in t])
    base = 0x9E3779B97F4A7C15
    power = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), b, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power(base)[:-1])])
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[of] + place
    return mix((sums[start + count + window - 1] - sums[start]) * power(pow(base, -1, 1 << 64))[start])


STRINGS = "bucket long, packed binary, key1 long, key2 long, low long, high long, row long, start int"
STRING_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("packed", pa.binary()), ("key1", pa.int64()), ("key2", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("row", pa.int64()), ("start", pa.int32())]
)


def repeated_ranges(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, mini: int = MINI) -> DataFrame:
    """doc, row, ranges: for every document with repeats, the word ranges (start, end) covered by windows that start in a document with a
    smaller id. doc is the id (LAST_ID for null), row a hash of the text that tells rows of one id apart."""
    spark = docs.sparkSession
    known = _identified(docs, id_column, text_column)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for ids, texts in word_chunks(batches):
            of, place, count, least = runs(texts, numbers, window, mini)
            if not len(of):
                continue
            doc = np.array([d for d, _ in ids], np.int64)[of]
            string = run_hashes(texts, numbers, of, place, count, window)
            order = np.lexsort((string, least))
            doc, least, string = doc[order], least[order], string[order]
            first = np.concatenate([[True], least[1:] != least[:-1]])
            other = first | np.concatenate([[True], string[1:] != string[:-1]])
            at = np.flatnonzero(first)
            columns = least[at].view(np.int64), np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at), np.add.reduceat(other.astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mini", "low", "high", "n"])

    per_mini = known.mapInArrow(shared, "mini long, low long, high long, n long").groupBy("mini").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    several = packed_table(per_mini.where("low < high").select("mini", "n"), "shared-minimisers")
    n_shared, n_strings = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << min(max((8 * n_shared).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    at = F.pmod("mini", F.lit(bits)) + 1
    blocks = several.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()  # at most bits / 8 bytes
    passing = bytearray(bits // 8)
    for block, bitmap in blocks:
        passing[(block - 1) * (BLOCK_BITS // 8) : block * (BLOCK_BITS // 8)] = bitmap
    least_hot = max(HOT_STRINGS, n_strings // MAX_HOT)
    hot = np.sort(np.array([r[0] for r in several.where(F.col("n") > least_hot).select("mini").collect()], np.int64))  # at most MAX_HOT
    held = spark.sparkContext.broadcast((np.frombuffer(bytes(passing), np.uint8), hot))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        filter_bytes, hot_minis = held.value
        numbers, out, digest = WordNumbers(), Out(STRING_SCHEMA), xxhash.xxh3_128_digest
        for ids, texts in word_chunks(batches):
            of, place, count, least = runs(texts, numbers, window, mini)
            bit = (least & np.uint64(bits - 1)).astype(np.int64)
            wanted = (filter_bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            of, place, count, least = of[wanted], place[wanted], count[wanted], least[wanted].view(np.int64)
            is_hot = np.isin(least, hot_minis) if len(hot_minis) else np.zeros(len(least), bool)
            seen: dict[bytes, list] = {}  # strings of this chunk: bucket, place of one occurrence, smallest and largest document
            for t, start, n, mini_hash, single in zip(of.tolist(), place.tolist(), count.tolist(), least.tolist(), is_hot.tolist(), strict=True):
                words, (doc, row) = texts[t], ids[t]
                for s, m in ((start + i, 1) for i in range(n)) if single else ((start, n),):
                    key = digest(b" ".join(words[s : s + m + window - 1]))
                    key1, key2 = _halves(key)
                    if (known_string := seen.get(key)) is None:
                        seen[key] = [key1 if single else mini_hash, t, s, m, doc, doc]
                    else:
                        known_string[4], known_string[5] = min(doc, known_string[4]), max(doc, known_string[5])
                    if out.add(None, None, key1, key2, doc, doc, row, s):
                        yield out.take()
            for key, (bucket, t, s, m, low, high) in seen.items():
                string = b" ".join(texts[t][s : s + m + window - 1])
                if out.add(bucket, string, *_halves(key), low, high, None, None, weight=len(string)):
                    yield out.take()
        yield from out.rest()

    strings = packed_table(known.mapInArrow(packed, STRINGS), "super-k-mers")
    buckets = strings.where("packed is not null").select("bucket", "key1", "key2", "packed", "low", "high").repartition("bucket").sortWithinPartitions("bucket")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(FOUND)
        for _, group in groupby(rows(batches, "bucket", "key1", "key2", "packed", "low", "high"), key=lambda r: r[0]):
            members: dict[tuple[int, int], list] = {}  # a minimiser of few strings, or equal hashes of single windows
            for _, key1, key2, string, low, high in group:
                if (same := members.get((key1, key2))) is None:
                    members[key1, key2] = [string, low, high]
                else:
                    same[1], same[2] = min(low, same[1]), max(high, same[2])
            if len(members) == 1 and all(low == high for _, low, high in members.values()):
                continue
            split = {key: m[0].split(b" ") for key, m in members.items()}
            lows: dict[bytes, int] = {}
            if len(members) > 1:
                for key, words in split.items():
                    low = members[key][1]
                    for i in range(len(words) - window + 1):
                        w = b" ".join(words[i : i + window])
                        if lows.get(w, LAST_ID) >= low:
                            lows[w] = low
            for (key1, key2), words in split.items():
                _, low, high = members[key1, key2]
                n = len(words) - window + 1
                found = [lows[b" ".join(words[i : i + window])] for i in range(n)] if lows else [low] * n
                ranges, at = [], 0
                for value, same_low in groupby(found):
                    size = len(list(same_low))
                    if value < high:
                        ranges.append({"first": at, "after": at + size, "least": value})
                    at += size
                if ranges and out.add(key1, key2, ranges):
                    yield out.take()
        yield from out.rest()

    found = buckets.mapInArrow(count, "key1 long, key2 long, found array<struct<first:int,after:int,least:bigint>>")
    places = strings.where("packed is null").select("key1", "key2", F.col("low").alias("doc"), "row", "start").join(found, ["key1", "key2"])
    repeated = F.filter("found", lambda r: r["least"] < F.col("doc"))
    span = lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["after"] + (window - 1)).alias("end"))
    spans = places.select("doc", "row", F.transform(repeated, span).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("ranges"))  # no more than the document has windows


def _halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


FOUND = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("found", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("least", pa.int64())])))])


def _covered(n: int, ranges: list[dict] | None) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(edges, [r["start"] for r in ranges], 1)
        np.add.at(edges, [r["end"] for r in ranges], -1)
    return np.cumsum(edges)[:n] > 0


def _with_ranges(docs: DataFrame, id_column: str, text_column: str, window: int, mini: int, columns: list) -> DataFrame:
    """The columns asked for, and the ranges as the last one. The helper columns' names clash with none of the input."""
    ranges = repeated_ranges(docs, id_column, text_column, window, mini)
    own = [order_id(id_column).alias(hidden("doc")), F.xxhash64(text_of(text_column)).alias(hidden("row"))]
    found = ranges.select(F.col("doc").alias(hidden("doc")), F.col("row").alias(hidden("row")), F.col("ranges").alias(RANGES))
    return docs.select(*columns, *own).join(found, [hidden("doc"), hidden("row")], "left").drop(hidden("doc"), hidden("row"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, mini: int = MINI) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the digest of the words that stay, joined by one space. A null or empty text has
    no words; a text shorter than a window keeps all. A null id counts as larger than any other; rows of equal ids do not count as each
    other's repeats; repeated rows are treated alike; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(RESULT)
        for doc_id, text, ranges in rows(batches, "id", "text", RANGES):
            words = words_of(text)
            gone = _covered(len(words), ranges) if ranges else None
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            if out.add(doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()):
                yield out.take()
        yield from out.rest()

    columns = [F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")]
    return _with_ranges(docs, id_column, text_column, window, mini, columns).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, mini: int = MINI) -> DataFrame:
    """The documents with repeated passages taken out of their texts: all rows and columns; a text without repeats stays byte for byte as it
    was, in another one the words that stay are joined by one space (empty if none stay)."""
    names = docs.columns
    at = names.index(text_column)
    kept = _with_ranges(docs, id_column, text_column, window, mini, [F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, ranges in enumerate(batch.column(len(names)).to_pylist()):
                if ranges:
                    words = words_of(texts[i])
                    gone = _covered(len(words), ranges).tolist()
                    texts[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, StructType(docs.schema.fields))
