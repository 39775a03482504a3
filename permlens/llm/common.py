"""What several operators of this folder share: words, row identities, shared folders, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permlens.session import work_folder

# A null doc_id sorts after every other id.
LAST_ID = 2**63 - 1

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def hidden(name: str) -> str:
    """A helper column's name that no input column has."""
    return f"__permlens_llm_{name}"


def order_id(column: str = "doc_id") -> Column:
    """The id as it is compared: nulls after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != LAST_ID, F.col(column))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text in UTF-8: exactly what splitting bytes on white space gives."""
    return text.encode().split() if text else []


def packed_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a large intermediate table to the session's shared folder, tightly compressed, and reads it back."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping arithmetic), so that neighbouring values land far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_kept: dict = {}


def kept(name, make):
    """What the operator of this name remembers in a Python worker from one task to the next. A worker holds one operator's memory only: what
    another one left behind goes first, so the stages of a pipeline do not add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordNumbers:
    """64-bit hashes of words, remembered within a task. The memory is emptied at a bound, which changes no result."""

    BOUND = 400_000

    def __init__(self) -> None:
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        self._seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self.BOUND:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self._hash(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


class Aging(dict):
    """Values learnt in bulk: at least the `limit` keys used last are remembered, and at most twice as many besides those in use."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that have to be learnt; the others are here."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        unknown = keys.difference(self)
        again = unknown.intersection(self.old)
        old = self.old
        self.update((k, old[k]) for k in again)
        return unknown - again


class Recent(dict):
    """Values made on demand and remembered within a task: at least the `limit` keys used last, at most twice as many."""

    def __init__(self, limit: int, make) -> None:
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def sequence_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for every n consecutive word hashes."""
    count = len(numbers) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out + numbers[i : i + count] + np.uint64(i + 1))
    return out


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def bounded(pairs: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Runs of (id, text) of a bounded number of characters; a single longer text is its own run."""
    held, size = [], 0
    for pair in pairs:
        if held and size + len(pair[1]) > chars:
            yield held
            held, size = [], 0
        held.append(pair)
        size += len(pair[1])
    if held:
        yield held


class Out:
    """Collects rows of a mapInArrow function and hands them out in batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 20_000, size: int = 16 << 20) -> None:
        self.schema, self.limit, self.size, self.held = schema, limit, size, 0
        self.data: list[list] = [[] for _ in schema]

    def add(self, *values, weight: int = 0) -> bool:
        for column, value in zip(self.data, values, strict=True):
            column.append(value)
        self.held += weight
        return len(self.data[0]) >= self.limit or self.held >= self.size

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.data, self.schema, strict=True)]
        self.data, self.held = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.data[0]:
            yield self.take()
