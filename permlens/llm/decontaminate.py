"""Operator 8: benchmark decontamination by rare seeds and local alignment.

Words are compared in lower case without punctuation at their ends; in scripts that set no spaces every character is a word. The score of an
item in a document is that of the best local alignment (Smith-Waterman over words: match 1, mismatch and gap -1) over the item's number
of words: 1 for a whole copy, 0.6 with a fifth of the words replaced. From MIN_SCORE on, the document holds the item. An item of fewer than
SEED words cannot be told from ordinary text: only documents that consist of it hold it.

All sequences of SEED words of an item are its seeds. A score from MIN_SCORE on leaves few errors, so few cuts between runs of equal words:
`seed_length` gives the number of an item's seeds that any such document has, and takes shorter seeds where it could be none. Of S seeds of
which a document has `need` at least, any S - need + 1 hold one: the rarest so many, by their documents in the corpus, join documents to
items. Of the documents met, the stretches that the whole item could cover around its seeds are aligned. The search is exact: it
finds what an alignment of every item with every whole document would.

Items and their seeds are tables made in tasks, and only their numbers and a bit string of fixed size pass the driver: the bit string lets
a task drop most sequences of a document that are no seeds. A document gives a row per different seed it has; its text comes again only
where it met an item. Documents are found again by (id, hash of the text), so equal rows share their results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permlens.llm import bloom
from permlens.llm.common import LAST_ID, Out, Recent, hidden, order_id, rows, sequence_hashes
from permlens.operators.spread import spread_join
from permlens.session import broadcast_if_small, is_small, written

SEED = 3
MIN_SCORE = 0.6
FILTER_BITS = 24  # a bit string of 2 ** FILTER_BITS bits (2 MB) for each length of seeds
ALONE = np.uint64(0x5851F42D4C957F2D)  # marks the hash of a whole short text
WIDE_ROWS = 20_000  # broadcast at most, of rows with items' words
EXPAND = 2_000_000  # seeds met by documents that are counted at once
CHUNK_CHARS = 4 << 20
CACHE_WORDS = 200_000
EDGE_BYTES = b" \t\n\r\v\f.,;:!?\"'`()[]{}<>*_~#%&$|/\\-+=^@"
# The scripts that are written without spaces between words.
SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
EDGE = " \t\n\r\v\f.,;:!?\"'`()[]{}<>*_~#%&$|/\\-+=^@‘’“”–—…«»"


class Words:
    """Word hashes; 0 for what is punctuation only."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.known = Recent(CACHE_WORDS, self._number)

    def _number(self, word: bytes) -> int:
        plain = word.lower().strip(EDGE_BYTES) if word.isascii() else word.decode().lower().strip(EDGE).encode()
        return max(1, self.hash(plain)) if plain else 0

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words, and their places in the text's white-space-separated words."""
        words = text.encode().split() if text else []
        if words and not text.isascii() and SPACELESS.search(text):
            parts = [(i, p) for i, w in enumerate(words) for p in ([w] if w.isascii() else self._characters(w))]
            of, words = np.array([i for i, _ in parts]), [p for _, p in parts]
        else:
            of = None
        numbers = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        places = np.flatnonzero(numbers)
        return numbers[places], places if of is None else of[places]

    def _characters(self, word: bytes) -> list[bytes]:
        """A word with every character of a script without spaces on its own."""
        return [p.encode() for p in SPACELESS.sub(lambda m: f" {m.group()} ", word.decode()).split(" ") if p]


def least_score(n: int, min_score: float) -> int:
    """The smallest alignment score that is min_score of n words."""
    least = int(np.ceil(min_score * n))
    while least > 1 and (least - 1) / n >= min_score:
        least -= 1
    return least if least / n >= min_score else least + 1


def seed_length(n: int, min_score: float) -> tuple[int, int]:
    """The length of an item's seeds and how many of them any document has that holds the item. Of n words M are matched, with E errors between
    at most E + 1 runs, and M - E >= least: so at least M - (length - 1) * (E + 1) sequences are whole, with M <= n and E <= M - least."""
    least = least_score(n, min_score)
    for length, whole in ((SEED, (SEED - 1) * (least - 1) - (SEED - 2) * n), (2, least - 1)):
        if whole > 0:
            return length, whole
    return 1, max(1, least)


class Seeds:
    """The seeds of one length, with the item that each stands in."""

    def __init__(self, length: int, items: list[int], words: list[np.ndarray]) -> None:
        self.length = length
        found = [sequence_hashes(w, length) for w in words]
        seeds = np.concatenate([*found, np.empty(0, np.uint64)])
        item = np.repeat(np.array(items, np.int64), [len(f) for f in found])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item = seeds[order], item[order]
        self.shift = np.uint64(64 - min(24, max(10, (16 * len(seeds)).bit_length())))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)  # by leading bits: most sequences are no seeds
        self.some[self.seeds >> self.shift] = True

    def places(self, joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place in the joined texts that has a seed: its text, the place, the seed's hash, and the first place among the seeds."""
        grams = sequence_hashes(joined, self.length)
        at = np.flatnonzero(self.some[grams >> self.shift])
        low = np.searchsorted(self.seeds, grams[at], "left")
        same = self.seeds[np.minimum(low, len(self.seeds) - 1)] == grams[at]
        at, low = at[same], low[same]
        text = np.searchsorted(ends, at, "right")
        inside = at + self.length <= ends[np.minimum(text, len(ends) - 1)]
        at, low, text = at[inside], low[inside], text[inside]
        return text, at, grams[at], low


@dataclass
class Items:
    """A block of items: their words, and for every length the seeds of the items that have seeds of this length."""

    ids: list[int | None]
    words: list[np.ndarray]
    min_score: float

    def __post_init__(self) -> None:
        lengths = [seed_length(len(w), self.min_score) for w in self.words]
        self.need = np.array([need for _, need in lengths], np.int64)
        self.tables = []
        for length in sorted({length for length, _ in lengths}):
            own = [i for i, (of, _) in enumerate(lengths) if of == length]
            self.tables.append(Seeds(length, own, [self.words[i] for i in own]))

    def pairs(self, table: Seeds, text: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) where the text has enough of the item's seeds."""
        met = np.unique(text * len(table.seeds) + low)  # a text's different seeds
        text, low = met // max(1, len(table.seeds)), met % max(1, len(table.seeds))
        count = np.searchsorted(table.seeds, table.seeds[low], "right") - low
        total = np.cumsum(count)
        start = 0
        while start < len(met):  # whole texts; one text meets no more seeds than the block has
            end = int(np.searchsorted(total, EXPAND + (total[start - 1] if start else 0), "right"))
            end = max(int(np.searchsorted(text, text[min(end, len(met) - 1)], "left")) if end < len(met) else end, int(np.searchsorted(text, text[start], "right")))
            own, first = count[start:end], low[start:end]
            seed = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first, own)
            pair, times = np.unique(np.repeat(text[start:end], own) * len(self.words) + table.item[seed], return_counts=True)
            pair = pair[times >= self.need[pair % len(self.words)]]
            yield from zip((pair // len(self.words)).tolist(), (pair % len(self.words)).tolist())
            start = end


def align(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every word of the text, the best score of an alignment of the item that ends there."""
    step = np.arange(1, len(text) + 1, dtype=np.int32)
    above = np.zeros(len(text) + 1, np.int32)
    best = np.zeros(len(text), np.int32)
    for word in item:
        now = np.maximum(above[:-1] + np.where(text == word, 1, -1).astype(np.int32), above[1:] - 1)
        np.maximum(now, 0, out=now)
        now += step
        np.maximum.accumulate(now, out=now)  # gaps in the text
        now -= step
        above[1:] = now
        np.maximum(best, now, out=best)
    return best


def _stretches(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping ranges merged, in order."""
    order = np.argsort(starts, kind="stable")
    merged: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def candidates(texts: list[np.ndarray], items: Items) -> dict[int, list[tuple[int, int, int]]]:
    """For every item the stretches (text, first word, end word) outside of which no document holds it."""
    wanted: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    joined = np.concatenate([*texts, np.empty(0, np.uint64)])
    ends = np.cumsum([len(t) for t in texts])
    for table in items.tables:
        text, at, seed, low = table.places(joined, ends)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t, i in items.pairs(table, text, low):
            if i not in own:
                found = sequence_hashes(items.words[i], table.length)
                order = np.argsort(found, kind="stable")
                own[i] = found[order], order
            seeds, place = own[i]
            here = slice(cuts[t], cuts[t + 1])
            first = np.searchsorted(seeds, seed[here], "left")
            count = np.searchsorted(seeds, seed[here], "right") - first
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            stands = place[np.repeat(first, count) + inner]
            begins = np.repeat(at[here], count) - (ends[t] - len(texts[t])) - stands
            size = len(items.words[i])
            reach = size - least_score(size, items.min_score)  # no more words can be inserted
            start, end = np.maximum(begins - reach, 0), np.minimum(begins + size + reach, len(texts[t]))
            wanted[i] += [(t, a, b) for a, b in _stretches(start, end)]
    return wanted


def likely(words: np.ndarray, joined: np.ndarray, starts: np.ndarray, min_score: float) -> np.ndarray:
    """Which of the joined stretches have enough of the item's pairs of words (see seed_length), counted by their places in the text."""
    pairs = np.unique(sequence_hashes(words, 2))
    grams = sequence_hashes(joined, 2)
    at = np.minimum(np.searchsorted(pairs, grams), len(pairs) - 1)
    same = np.concatenate([[0], np.cumsum(pairs[at] == grams)])
    edges = np.minimum(np.append(starts, len(joined)), len(grams))
    return same[edges[1:]] - same[edges[:-1]] >= least_score(len(words), min_score) - 1


def find(texts: list[np.ndarray], items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the best alignment of every item with every text that holds it."""
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i, ranges in candidates(texts, items).items():
        words = items.words[i]
        between = np.zeros(len(words) + 1, np.uint64)  # no alignment outlives so many gaps; 0 is no word
        if len(words) > 1:
            starts = np.cumsum([0, *(b - a for _, a, b in ranges[:-1])])
            some = likely(words, np.concatenate([texts[t][a:b] for t, a, b in ranges]), starts, items.min_score)
            ranges = [r for r, keep in zip(ranges, some.tolist()) if keep]
            if not ranges:
                continue
        joined = np.concatenate([x for t, a, b in ranges for x in (texts[t][a:b], between)])
        best = align(words, joined)
        low = 0
        for t, a, b in ranges:
            own = best[low : low + b - a]
            end = int(own.argmax())
            score = float(own[end]) / len(words)
            if score >= items.min_score and score > found.get((t, i), (0.0,))[0]:
                found[t, i] = score, a, a + end + 1
            low += b - a + len(between)
    out = []
    for (t, i), (score, a, end) in sorted(found.items()):
        back = align(items.words[i][::-1], texts[t][a:end][::-1])  # where the same alignment begins
        out.append((t, i, score, end - 1 - int(back.argmax()), end))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        texts, start, size = batch.column(column).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            if i > start and size + len(text or "") > CHUNK_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text or "")
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def _alone(numbers: np.ndarray) -> np.ndarray:
    """The hash of a whole text of fewer than SEED words."""
    return sequence_hashes(numbers, len(numbers)) ^ ALONE


def items_table(benchmark: DataFrame, id_column: str, text_column: str, min_score: float = MIN_SCORE) -> DataFrame:
    """item_no, item_id, words (hashes), length and different seeds of every item with words, and how many seeds a document that holds it has
    at least. Length 0: a short item, whose one seed is that of a whole text."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("length", pa.int32()), ("need", pa.int32()), ("seeds", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Words(), Out(schema)
        for item_id, text in rows(batches, "item_id", "text"):
            numbers, _ = words(text)
            if len(numbers):
                length, need = seed_length(len(numbers), min_score) if len(numbers) >= SEED else (0, 1)
                seeds = np.unique(sequence_hashes(numbers, length) if length else _alone(numbers))
                if out.add(item_id, numbers.view(np.int64), length, min(need, len(seeds)), seeds.view(np.int64), weight=16 * len(numbers)):
                    yield out.take()
        yield from out.rest()

    wanted = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text"))
    found = wanted.mapInArrow(run, "item_id long, words array<long>, length int, need int, seeds array<long>")
    return written(found.withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit per leading FILTER_BITS bits of (seed): set where a seed begins so."""
    at = F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1
    blocks = seeds.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    some = np.zeros(1 << FILTER_BITS, bool)
    for block, bits in blocks.toLocalIterator():  # together 2 ** FILTER_BITS bits
        unpacked = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        low = (block - 1) * len(unpacked)
        some[low : low + len(unpacked)] = unpacked[: max(0, len(some) - low)]
    return some


def _identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(order_id(id_column).alias("rank_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def met_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(rank_id, text_hash, item_no) of the documents that have one of an item's rarest seeds. docs: rank_id, text_hash, text."""
    seeds = written(items.select("item_no", "length", "need", F.size("seeds").alias("n"), F.explode("seeds").alias("seed")), "benchmark-seeds")
    lengths = [r[0] for r in seeds.select("length").distinct().collect()]  # 0 to SEED
    held = docs.sparkSession.sparkContext.broadcast({length: np.packbits(seed_filter(seeds.where(F.col("length") == length))) for length in lengths})
    bits = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, some = Words(), {length: np.unpackbits(b)[: 1 << FILTER_BITS].astype(bool) for length, b in held.value.items()}
        for batch in batches:
            for part, texts in _chunks(iter([batch]), 2):
                numbers = [words(t)[0] for t in texts]
                ends = np.cumsum([len(n) for n in numbers])
                joined = np.concatenate([*numbers, np.empty(0, np.uint64)])
                of, seed = [], []
                for length, own in some.items():
                    if length:
                        grams = sequence_hashes(joined, length)
                        at = np.flatnonzero(own[grams >> bits])
                        text = np.searchsorted(ends, at, "right")
                        inside = at + length <= ends[np.minimum(text, len(ends) - 1)]
                        of.append(text[inside])
                        seed.append(grams[at[inside]])
                    else:
                        short = [i for i, n in enumerate(numbers) if 0 < len(n) < SEED]
                        grams = np.concatenate([*(_alone(numbers[i]) for i in short), np.empty(0, np.uint64)])
                        likely_ = own[grams >> bits]
                        of.append(np.array(short, np.int64)[likely_])
                        seed.append(grams[likely_])
                if of and sum(map(len, of)):
                    pair = np.unique(np.stack([np.concatenate(of).astype(np.int64), np.concatenate(seed).view(np.int64)]), axis=1)
                    where = pa.array(pair[0])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(pair[1])], names=["rank_id", "text_hash", "seed"])

    emitted = docs.mapInArrow(run, "rank_id long, text_hash long, seed long")
    found = written(emitted.join(broadcast_if_small(seeds.select("seed").distinct()), "seed", "left_semi"), "seeds-found")
    often = found.groupBy("seed").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("item_no").orderBy(F.coalesce("df", F.lit(0)), "seed")
    rare = seeds.join(broadcast_if_small(often), "seed", "left").withColumn("place", F.row_number().over(rarest)).where("place <= n - need + 1").select("seed", "item_no")
    return spread_join(rare, found, ["seed"], ["rank_id", "text_hash"]).select("i.rank_id", "i.text_hash", "w.item_no").distinct()


HITS = pa.schema([("rank_id", pa.int64()), ("text_hash", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def _hits(docs: DataFrame, benchmark: DataFrame, min_score: float, id_column: str, text_column: str, item_column: str, item_text: str) -> DataFrame:
    known = _identified(docs, id_column, text_column)
    items = items_table(benchmark, item_column, item_text, min_score)
    met = met_items(known, items)
    wanted = met.join(broadcast_if_small(items.select("item_no", "item_id", "words"), WIDE_ROWS), "item_no")
    listed = written(wanted.groupBy("rank_id", "text_hash").agg(F.collect_list(F.struct("item_no", "item_id", "words")).alias("items")), "documents-met")
    keys = listed.select(F.xxhash64("rank_id", "text_hash").alias("key"))
    if is_small(listed, WIDE_ROWS):
        again = known.join(F.broadcast(listed), ["rank_id", "text_hash"])
    else:  # only texts that met an item are shuffled
        again = known.where(bloom.likely(keys, F.xxhash64("rank_id", "text_hash"))).join(listed, ["rank_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Words(), Out(HITS)
        for batch in batches:
            for part, texts in _chunks(iter([batch.select(["rank_id", "text_hash", "text", "items"])]), 2):
                own = part.column(3).flatten().to_pylist()
                by_no = {i["item_no"]: i for i in own}
                asked = [(i["item_id"], np.array(i["words"], np.int64).view(np.uint64)) for i in by_no.values()]
                long, short = ([a for a in asked if (len(a[1]) >= SEED) == is_long] for is_long in (True, False))
                numbers = [words(t) for t in texts]
                block = Items([i for i, _ in long], [w for _, w in long], min_score)
                found = [(t, block.ids[i], score, start, end) for t, i, score, start, end in (find([n for n, _ in numbers], block) if long else [])]
                found += [(t, i, 1.0, 0, len(n)) for t, (n, _) in enumerate(numbers) for i, w in short if np.array_equal(n, w)]
                for t, item_id, score, start, end in found:
                    places, rank_id = numbers[t][1], part.column(0)[t].as_py()
                    out.add(rank_id, part.column(1)[t].as_py(), None if rank_id == LAST_ID else rank_id, item_id, score, int(places[start]), int(places[end - 1]) + 1)
                if out.data[0]:
                    yield out.take()

    return again.select("rank_id", "text_hash", "text", "items").mapInArrow(run, "rank_id long, text_hash long, doc_id long, item_id long, score double, start_word long, end_word long")


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, score, start_word and end_word (places of white-space-separated words,
    end exclusive). Null and empty texts and items hold nothing and are held by nothing; null ids stay null; repeated documents and items
    give rows of their own; other columns are not looked at; no documents or no items give no rows."""
    return _hits(docs, benchmark, min_score, id_column, text_column, item_column, item_text).drop("rank_id", "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all rows and columns as they were, nulls, empty texts and repeated rows included; without items
    all documents."""
    bad = written(_hits(docs, benchmark, min_score, id_column, text_column, item_column, item_text).select("rank_id", "text_hash").distinct(), "documents-leaked")
    own, text = hidden("rank_id"), hidden("text_hash")
    marked = docs.withColumns({own: order_id(id_column), text: F.xxhash64(F.col(text_column).cast("string"))})
    return marked.join(broadcast_if_small(bad.toDF(own, text)), [own, text], "left_anti").drop(own, text)
