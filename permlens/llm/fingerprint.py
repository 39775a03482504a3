"""Operator 9: document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts. For every word and sample, three numbers that depend on the word alone (r and c drawn
from Gamma(2, 1), b uniform) give the word's claim at its weight w: t = floor(ln w / r + b), claim = ln c - r (t - b) - r; the smallest
claim wins the sample, and (word, t) is its value. Two texts agree in a sample with a probability equal to their generalised Jaccard
similarity (sum of smaller counts over sum of larger counts), so the share of equal samples estimates it. A fingerprint is 16 bits of a
hash of each sample's value, in hexadecimal; the empty text's fingerprint is the empty string, like itself (1) and unlike others (0).

Neighbours in the order of ids come from one range partitioning by id: every task sees its documents in order, and only one text per task
waits for its neighbour, which starts the next task's range.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permlens.llm.common import LAST_ID, Out, bounded, mix, order_id, rows, text_of
from permlens.session import written

SAMPLES = 64
CACHE_WORDS = 100_000
BLOCK_PAIRS = 20_000
STEP_WORDS = 256  # whose arrays stay in a core's cache
CHUNK_CHARS = 2 << 20
PIECE = 1 << 20
FOLD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)  # odd factors
BELOW_ONE = np.float32(1 - 2.0**-24)
NO_KEY = np.iinfo(np.int64).max
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _ordered(claims: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in the order of the claims."""
    bits = claims.astype(np.float32).view(np.int32)
    return (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)


class Sampler:
    """Fingerprints of texts in blocks of (word, count) pairs. What depends on a word alone is drawn once per word and remembered within a
    task, up to a bound that changes no result.

    A pair's claim and its value are one whole number, the claim in front: the smallest number of a text wins the sample and brings its value,
    and of equal claims the smaller value wins, so neither the order of words nor the blocks matter."""

    def __init__(self, samples: int = SAMPLES) -> None:
        import xxhash

        self.hash, self.samples = xxhash.xxh3_64_intdigest, samples
        self.seeds = [mix(np.arange(samples, dtype=np.uint64) * np.uint64(8) + np.uint64(i + 1)) for i in range(2)]
        self.place: dict[bytes, int] = {}
        rows = CACHE_WORDS + BLOCK_PAIRS
        self.keys = np.empty((rows, samples), np.int64)  # at weight 1
        self.words = np.empty(rows, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.place)
        at = slice(first, first + len(words))
        self.words[at] = [*map(self.hash, words)]
        self.place.update(zip(words, range(first, at.stop), strict=True))
        for i in range(first, at.stop, STEP_WORDS):
            step = slice(i, min(i + STEP_WORDS, at.stop))
            self.keys[step] = self._keys(self.words[step])

    def _keys(self, words: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The keys of hashed words with their counts (1 where none are given)."""
        x, y = (mix(words[:, None] ^ seed) for seed in self.seeds)
        u, v = ((h.view(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32) for h in (x, y))  # two draws of 32 bits each
        r = -np.log(np.minimum(u[:, 0::2] * u[:, 1::2], BELOW_ONE))
        log_c = np.log(-np.log(np.minimum(v[:, 0::2] * v[:, 1::2], BELOW_ONE)))
        b = ((x * FOLD) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        if counts is None:
            value, claim = x, log_c + r * b - r
        else:
            t = np.floor(np.log(counts.astype(np.float32))[:, None] / r + b)
            value, claim = x + t.astype(np.uint64), log_c - r * (t - b) - r
        return (_ordered(claim) << 16) | ((value * SPREAD) >> np.uint64(48)).astype(np.int64)

    def prints(self, texts: list[str]) -> list[np.ndarray | None]:
        """One array of sample values per text; None for a text without words."""
        best = np.full((len(texts), self.samples), NO_KEY)
        words: list[bytes] = []
        counts: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            data = text.encode()
            found = Counter(data.split()) if len(data) <= PIECE else Counter()
            for piece in _pieces(data) if len(data) > PIECE else ():
                found.update(piece.split())
            words += found
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
            owner.append((i, len(found)))
            if len(words) >= BLOCK_PAIRS or i == len(texts) - 1:
                times = np.concatenate(counts)
                of = np.repeat([o for o, _ in owner], [n for _, n in owner])
                for at in range(0, len(words), BLOCK_PAIRS):
                    part = slice(at, at + BLOCK_PAIRS)
                    self._meet(best, words[part], times[part], of[part])
                words, counts, owner = [], [], []
        values = (best & 0xFFFF).astype(np.uint16)
        return [v if k[0] != NO_KEY else None for k, v in zip(best, values, strict=True)]

    def _meet(self, best: np.ndarray, words: list[bytes], times: np.ndarray, owner: np.ndarray) -> None:
        """Lowers the best keys of the texts by those of some of their pairs."""
        new = set(words).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS + BLOCK_PAIRS:
            self.place.clear()
            new = set(words)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        keys = self.keys[at]
        often = np.flatnonzero(times > 1)
        if len(often):
            pairs, back = np.unique(np.stack([at[often], times[often]]), axis=1, return_inverse=True)
            found = np.empty((pairs.shape[1], self.samples), np.int64)
            for i in range(0, len(found), STEP_WORDS):
                found[i : i + STEP_WORDS] = self._keys(self.words[pairs[0, i : i + STEP_WORDS]], pairs[1, i : i + STEP_WORDS])
            keys[often] = found[back.ravel()]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        docs = owner[starts]
        best[docs] = np.minimum(best[docs], np.minimum.reduceat(keys, starts, axis=0))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Runs of whole words of a bounded size."""
    start = 0
    while start < len(data):
        gap = SPACE.search(data, start + PIECE)
        end = gap.start() if gap else len(data)
        yield data[start:end]
        start = end


def as_text(sample: np.ndarray | None) -> str:
    return "" if sample is None else sample.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for group in bounded(rows(batches, "doc_id", "text"), CHUNK_CHARS):
            found = sampler.prints([t for _, t in group])
            data = [{"doc_id": i, "n_chars": len(t), "fingerprint": as_text(f)} for (i, t), f in zip(group, found, strict=True)]
            yield pa.RecordBatch.from_pylist(data, schema=PRINTS)

    wanted = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
PASSED = pa.schema([("part", pa.int32()), ("kind", pa.string()), *RESULT, ("text", pa.string())])
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last half replaced by the beginning of the next document in
    descending order of (doc_id, text), after the last one of the first), the likeness of the two, and of its fingerprint to the next
    document's. A null text is empty; null ids come first in descending order. Repeated ids and rows are neighbours of one another; a
    single row is its own neighbour; no rows give no rows."""
    ordered = docs.select(order_id().alias("doc_id"), text_of().alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc(), F.xxhash64("text").desc()).sortWithinPartitions(F.col("doc_id").desc(), F.xxhash64("text").desc(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part, last = Sampler(), TaskContext.get().partitionId(), None
        for group in bounded(rows(batches, "doc_id", "text"), CHUNK_CHARS):
            own = sampler.prints([t for _, t in group])
            chain = [*([last] if last else []), *((i, t, f) for (i, t), f in zip(group, own, strict=True))]
            edited = [edited_text(a[1], b[1]) for a, b in zip(chain, chain[1:])]
            out = Out(PASSED)
            if last is None:
                out.add(part, "first", chain[0][0], None, None, as_text(chain[0][2]), None, None, None, chain[0][1])
            for (doc_id, text, f), (_, _, following), e, ef in zip(chain, chain[1:], edited, sampler.prints(edited)):
                out.add(part, "done", *_row(doc_id, text, f, following, e, ef), None)
            yield from out.rest()
            last = chain[-1]
        if last:
            out = Out(PASSED)
            out.add(part, "last", last[0], None, None, as_text(last[2]), None, None, None, last[1])
            yield from out.rest()

    passed = written(ordered.mapInArrow(run, f"part int, kind string, {COLUMNS}, text string"), "fingerprints")
    done = passed.where("kind = 'done'").select([name for name, _ in RESULT])
    parts = passed.where("kind = 'first'").select("part")  # one row per task
    round_trip = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.withColumn("following", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(round_trip)))
    first = passed.where("kind = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    waiting = passed.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(first, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, out = Sampler(), Out(pa.schema(RESULT))
        for doc_id, text, own, after, next_print in rows(batches, "doc_id", "text", "fingerprint", "next_text", "next_print"):
            e = edited_text(text, after)
            if out.add(*_row(doc_id, text, _parsed(own), _parsed(next_print), e, sampler.prints([e])[0])):
                yield out.take()
        yield from out.rest()

    return done.unionByName(waiting.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(finish, COLUMNS))


def _parsed(text: str) -> np.ndarray | None:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16) if text else None


def _row(doc_id, text, own, following, edited, edited_print) -> tuple:
    return (None if doc_id == LAST_ID else doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(edited_print), likeness(own, edited_print), likeness(own, following))
