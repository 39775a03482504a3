"""Operator 12: how the vocabulary of sources differs within a language, by in-mapper stripes.

A task folds whole documents into stripes: for every language a hash from term to its document frequency, and beside it one hash per source from
term to its occurrences, so a term's stripe is (document frequency, counts by source). Beyond a bound on held entries the stripes are spilled as
rows and the hashes start anew. Rows are merged by (language, term): hot terms come once per spill, so no term is one task's work. Each merged
stripe of a kept term then meets its language's totals and emits its divergences: a share of every pair of sources, summed in the task, and
candidates for the most typical terms, of which a task hands on its best.

A term's probability in a group with `count` occurrences is 1 + floor(10 ** 9 * (count + 5) / (N + 5 V)), in whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permlens.llm.common import rows, text_of
from permlens.operators.spread import spread_join
from permlens.session import written

MIN_DOCUMENTS, TOP, SMOOTHING = 30, 50, 5
SPILL_ENTRIES = 400_000
CELLS = 1 << 20  # of a matrix of terms and sources
PIECE = 1 << 20

# Letters stay (A-Z in lower case), and so does everything beyond ASCII; all else ends a term.
TERM_BYTES = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded number of bytes."""
    data = text.encode().translate(TERM_BYTES)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= PIECE else data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class Stripes:
    """Per language: term -> documents, and per source: term -> occurrences."""

    def __init__(self) -> None:
        self.documents: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.held = 0

    def fold(self, lang: str, source: str, text: str) -> None:
        documents = self.documents.setdefault(lang, Counter())
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before, seen = len(documents) + len(counts), set()
        for terms in terms_of(text):
            counts.update(terms)
            seen.update(terms)
        documents.update(seen)
        self.held += len(documents) + len(counts) - before

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, documents in self.documents.items():
            if documents:
                yield from _striped(lang, documents, self.counts[lang])
        self.__init__()


STRIPE = "lang string, term string, documents long, cells array<struct<source: string, n: bigint>>"


def _striped(lang: str, documents: Counter, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    place = dict(zip(documents, range(len(documents))))
    sources = list(counts)
    of_term = np.concatenate([np.fromiter(map(place.__getitem__, counts[s]), np.int64, len(counts[s])) for s in sources])
    n = np.concatenate([np.fromiter(counts[s].values(), np.int64, len(counts[s])) for s in sources])
    of_source = np.repeat(np.arange(len(sources)), [len(counts[s]) for s in sources])
    order = np.argsort(of_term, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of_term, minlength=len(place)))]).astype(np.int32)
    named = pa.array(sources, pa.string()).take(pa.array(of_source[order]))
    cells = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([named, pa.array(n[order])], ["source", "n"]))
    term = pa.array(list(documents), pa.binary()).cast(pa.string())
    held = pa.array(np.fromiter(documents.values(), np.int64, len(place)))
    batch = pa.RecordBatch.from_arrays([pa.repeat(lang, len(place)), term, held, cells], names=["lang", "term", "documents", "cells"])
    for at in range(0, len(place), 20_000):
        yield batch.slice(at, 20_000)


def stripes(docs: DataFrame) -> DataFrame:
    """lang, term, documents, cells (source, n) of every term of every language: the merged stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for lang, source, text in rows(batches, "lang", "source", "text"):
            held.fold(lang, source, text)
            if held.held >= SPILL_ENTRIES:
                yield from held.spill()
        yield from held.spill()

    spilled = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text")).mapInArrow(run, STRIPE)
    cells = spilled.repartition("lang", "term").select("lang", "term", "documents", F.posexplode("cells").alias("at", "cell"))
    counted = cells.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("documents")).otherwise(0)).alias("documents"))
    return counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("cells"))


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10 ** 9 * count / total) without leaving 64 bits, for totals up to 9 * 10 ** 15."""
    quotient, rest = np.zeros_like(count), count
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // total, rest * 1000 % total
    return 1 + quotient


def divergences(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language and the summed difference of probabilities over all
    kept terms (0 if there are none). Part `term`: the source's terms that are likelier there than in the language, by the difference, the
    first `top`. Null text, lang and source are ''; groups without terms have their pairs; the ranks of equal values follow the item's
    bytes; repeated rows count as documents of their own; an empty table gives no rows."""
    kept = written(stripes(docs).where(F.col("documents") >= min_documents).select("lang", "term", "cells"), "stripes")
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    counted = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    filled = groups.join(counted, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("group"))
    langs = written(filled.groupBy("lang").agg(F.sort_array(F.collect_list("group")).alias("groups")).join(vocabulary, "lang", "left"), "stripe-totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, typical = Pairs(), Typical(top)
        for batch in batches:
            found = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(found.dictionary.to_pylist()):
                at = np.flatnonzero(found.indices.to_numpy() == code)
                groups = batch.column("groups")[int(at[0])].values
                sources, n, v = groups.field("source"), groups.field("n").to_numpy(), batch.column("v")[int(at[0])].as_py()
                step = max(1, CELLS // len(n))
                for i in range(0, len(at), step):
                    some = pa.array(at[i : i + step])
                    count = _matrix(batch.column("cells").take(some), sources)
                    p, q = share(count + SMOOTHING, n + SMOOTHING * v), share(count.sum(1) + SMOOTHING, int(n.sum()) + SMOOTHING * v)
                    typical.add(lang, sources, batch.column("term").take(some), count, p - q[:, None])
                    yield from pairs.add(lang, sources, p)
        yield from pairs.spill()
        yield from typical.spill()

    joined = spread_join(langs, kept, ["lang"], ["lang", "term"]).select("i.lang", "i.term", "i.cells", "w.groups", "w.v")
    emitted = written(joined.mapInArrow(run, "lang string, source string, part string, item string, value long"), "divergences")
    every = langs.select("lang", "groups.source", F.explode("groups.source").alias("item")).select("lang", F.explode("source").alias("source"), "item")
    every = every.where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = every.unionByName(emitted.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    place = F.row_number().over(by_value).alias("rank")
    return pairs.select("*", place).unionByName(emitted.where("part = 'term'").select("*", place).where(F.col("rank") <= top))


def _matrix(cells: pa.ListArray, sources: pa.Array) -> np.ndarray:
    """Counts by term and source."""
    flat = cells.flatten()
    lengths = pc.list_value_length(cells).to_numpy()
    count = np.zeros((len(cells), len(sources)), np.int64)
    count[np.repeat(np.arange(len(cells)), lengths), pc.index_in(flat.field("source"), value_set=sources).to_numpy()] = flat.field("n").to_numpy()
    return count


def _emitted(lang: str, source: str, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.repeat(part, n), items.cast(pa.string()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


class Pairs:
    """Sums of differences by pair of sources, handed on beyond a bound."""

    LIMIT = 1 << 21

    def __init__(self) -> None:
        self.sums: dict[tuple[str, int], np.ndarray] = {}
        self.sources: dict[str, pa.Array] = {}
        self.held = 0

    def add(self, lang: str, sources: pa.Array, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.sources[lang] = sources
        for a in range(p.shape[1]):
            differences = np.abs(p - p[:, a : a + 1]).sum(0)
            if (lang, a) in self.sums:
                self.sums[lang, a] += differences
            else:
                self.sums[lang, a] = differences
                self.held += len(differences)
                if self.held > self.LIMIT:
                    yield from self.spill()

    def spill(self) -> Iterator[pa.RecordBatch]:
        for (lang, a), sums in self.sums.items():
            others = np.flatnonzero(np.arange(len(sums)) != a)
            if len(others):
                yield _emitted(lang, self.sources[lang][a].as_py(), "pair", self.sources[lang].take(pa.array(others)), sums[others])
        self.sums, self.held = {}, 0


class Typical:
    """The best terms of every group that a task has met, by value and then by the term's bytes."""

    def __init__(self, top: int) -> None:
        self.top, self.best = top, {}

    def add(self, lang: str, sources: pa.Array, terms: pa.Array, count: np.ndarray, gain: np.ndarray) -> None:
        for a in range(count.shape[1]):
            key = (lang, sources[a].as_py())
            held = self.best.get(key, [])
            least = -held[-1][0] if len(held) == self.top else 1
            at = np.flatnonzero((count[:, a] > 0) & (gain[:, a] >= least))
            if len(at) > self.top:
                at = at[gain[at, a] >= np.partition(gain[at, a], len(at) - self.top)[len(at) - self.top]]
            if len(at):
                new = zip((-gain[at, a]).tolist(), (t.encode() for t in terms.take(pa.array(at)).to_pylist()))
                self.best[key] = sorted([*held, *new])[: self.top]

    def spill(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), held in self.best.items():
            yield _emitted(lang, source, "term", pa.array([t for _, t in held], pa.binary()), np.array([-v for v, _ in held]))
