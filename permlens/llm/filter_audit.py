"""Operator 11: what filters remove together, for every order in which they could run.

Every document becomes a truth-table word of 2 ** n bits (32 for five filters): bit S is set where the document survives the set S of filters, that is,
where it fails none of them. One word so answers every order at once, as a prefix of an order is a set. Words are counted bit by bit, per part
and label: planes of words go through carry-save adders (three words of one weight become a sum of that weight and a carry of the next) until
at most two words a weight are left, whose bits are read off. Tasks hand on 32 totals a part, whatever the number of documents.

`text_failures` applies the five filters of the query; `survivors` and `orders` take any failures of at most five filters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.llm.common import UPPER, Out, order_id, rows, text_of
from permlens.session import broadcast_if_small, written

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
SYMBOLS = re.compile(r"[#$%&*|]")
COPY = 1 << LETTERS.index("E")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
HELD_PARTS = 2_000
LABELS = ("total", "good", "toxic")


def _distinct_words(data: bytes) -> tuple[int, int]:
    """The numbers of words and of different words, over pieces of a bounded size that end where a word ends."""
    n, seen, start = 0, set(), 0
    while start < len(data):
        gap = SPACE.search(data, start + PIECE)
        end = gap.start() if gap else len(data)
        words = data[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def text_mask(text: str) -> int:
    """The failed conditions of a text alone: A few words, B repeated words, C capitals, D symbols."""
    data = text.encode()
    n, distinct = _distinct_words(data)
    upper = len(data) - len(data.translate(None, UPPER.encode()))
    return (
        (n < MIN_WORDS)
        | (100 * distinct < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * upper > MAX_UPPER_PERCENT * len(text)) << 2
        | (SYMBOLS.search(text) is not None) << 3
    )


def text_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit 0 for A to bit 4 for E), good, toxic of every row of the documents. A null text is empty, a null source the part ''.
    E: an equal text has a smaller doc_id, whatever part it is in; a null id is larger than all others, and rows of one id are no copies of
    each other. A document is good (toxic) where any of its labels says so; labels without an id count for nothing.

    Which text comes first is decided on digests alone and found again by (id, digest), so a group of copies is never one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("rank_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails", pa.int32())]))
        for doc_id, rank_id, part, text in rows(batches, "doc_id", "rank_id", "part", "text"):
            if out.add(doc_id, rank_id, part, hashlib.blake2b(text.encode(), digest_size=16).digest(), int(text_mask(text))):
                yield out.take()
        yield from out.rest()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("rank_id"), text_of("source").alias("part"), text_of().alias("text"))
    judged = written(wanted.mapInArrow(run, "doc_id long, rank_id long, part string, digest binary, fails int"), "filter-masks")
    first = judged.groupBy("digest").agg(F.min("rank_id").alias("rank_id")).withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    found = judged.join(first, ["rank_id", "digest"], "left").join(broadcast_if_small(marks), "doc_id", "left")
    fails = F.col("fails") + F.when(F.col("is_first"), 0).otherwise(COPY)
    return found.select("part", fails.cast("int").alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survival_words() -> np.ndarray:
    """For every set of failed filters, the word whose bit S is set where S holds none of them."""
    sets = np.arange(32, dtype=np.uint32)
    alive = (sets[:, None] & sets[None, :]) == 0
    return (alive.astype(np.uint32) << sets[None, :]).sum(1, dtype=np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set, by carry-save adders."""
    counts, weight, plane = np.zeros(32, np.int64), 1, words.astype(np.uint32, copy=False)
    while len(plane):
        carries = []
        while len(plane) >= 3:
            n = len(plane) // 3
            a, b, c = plane[:n], plane[n : 2 * n], plane[2 * n : 3 * n]
            either = a ^ b
            carries.append((a & b) | (either & c))
            plane = np.concatenate([either ^ c, plane[3 * n :]])
        for word in plane:
            counts += weight * ((word >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.int64)
        plane = np.concatenate(carries) if carries else plane[:0]
        weight *= 2
    return counts


def survivors(failures: DataFrame) -> DataFrame:
    """part, subset (bits of the filters in it), and total, good, toxic: how many of all, good and toxic documents survive the subset."""
    word_of = survival_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            codes = parts.indices.to_numpy()
            words = word_of[batch.column("fails").to_numpy()]
            marks = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in LABELS[1:])]
            order = np.argsort(codes, kind="stable")
            names, starts = np.unique(codes[order], return_index=True)
            for code, rows_of_part in zip(names, np.split(order, starts[1:]), strict=True):
                total = held.setdefault(parts.dictionary[int(code)].as_py(), np.zeros((3, 32), np.int64))
                for i, mark in enumerate(marks):
                    total[i] += positional_popcount(words[rows_of_part[mark[rows_of_part]]])
                if len(held) >= HELD_PARTS:
                    yield _totals(held)
                    held.clear()
        if held:
            yield _totals(held)

    counted = failures.mapInArrow(run, "part string, subset int, total long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in LABELS])


def _totals(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    values = np.concatenate([v for v in held.values()], axis=1)
    names = pa.array(list(held)).take(pa.array(np.repeat(np.arange(len(held)), 32)))
    return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(32, dtype=np.int32), len(held))), *map(pa.array, values)], names=["part", "subset", *LABELS])


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders(survived: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps and removes, how many of those that fail its filter were gone
    before (redundant) or fail it alone (unique_fails), the good and toxic ones it removes, and the filter's removals summed over all orders."""
    names = ["".join(p) for p in permutations(LETTERS)]
    filters = np.array([[LETTERS.index(c) for c in name] for name in names])
    after = np.cumsum(1 << filters, axis=1).ravel()
    own = 1 << filters.ravel()
    before = after - own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, subsets in zip(batch.column("part"), batch.column("subsets"), strict=True):
                flat = subsets.values
                total, good, toxic = (flat.field(c).to_numpy() for c in LABELS)
                removed = total[before] - total[after]
                shapley = np.zeros(len(LETTERS), np.int64)
                np.add.at(shapley, filters.ravel(), removed)
                columns = [
                    pa.repeat(part, len(own)), pa.array(np.repeat(names, 5).tolist()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(names))), total[after], removed,
                    total[0] - total[own] - removed, total[31 - own] - total[31], good[before] - good[after], toxic[before] - toxic[after], shapley[filters.ravel()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in REPORT.split(", ")])

    whole = survived.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *LABELS))).alias("subsets"))
    return whole.mapInArrow(run, REPORT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over the five text filters. No documents, no parts, no rows; each part has all 600 rows."""
    return orders(survivors(text_failures(docs, labels)))
