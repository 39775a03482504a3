"""Scoring by blocks: every block of stored rows meets every block of requests of its group once, and only what can be in a top n leaves.

Stored rows are packed in a narrow pass into blocks of bounded size, one row each, whose arrays are numpy's; requests likewise. A cell (block
of rows, block of requests) is one row of an equal-key join: few request blocks are broadcast and the stored blocks stay where they are,
else both are shuffled, every group dealt to many tasks. No (request, row) pair is ever a row of a table before it is among a task's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.operators.spread import spread_join
from permlens.operators.sweep import FIRST, LAST, micros
from permlens.session import broadcast_if_small, is_small

BLOCK_ROWS = 4096
BLOCK_REQUESTS = 1024
BROADCAST_BLOCKS = 32  # of requests
HELD_ROWS = 1 << 20
CELLS = 1 << 20  # of a matrix of requests and rows
SALTS, DEALS = 16, 8  # of stored blocks and of blocks of requests, where both are shuffled
RIGHTS = 64  # in a block of requests, that are scored one by one
HALF_DIGIT = 5e-10  # of a score

COMMON = "rows binary, labels binary, opens binary, closes binary"


def windows() -> list[Column]:
    """The validity window as microseconds, open sides beyond all times."""
    return [F.coalesce(micros("valid_from"), F.lit(FIRST)).alias("opens"), F.coalesce(micros("valid_to"), F.lit(LAST)).alias("closes")]


def stored_blocks(rows: DataFrame, on: list[str], payload: list[str], pack: Callable[[pa.Table], dict], schema: str, block_rows: int | None = None) -> DataFrame:
    """Packs rows (on, chunk_no, label_no, valid_from, valid_to, payload) into blocks of one group each: a narrow pass, in which a task holds at
    most a few blocks of open groups. `pack` makes the payload's columns of `schema` from a block's rows in the order of chunk_no."""
    limit = block_rows or BLOCK_ROWS
    names = [*on, "rows", "labels", "opens", "closes", *[f.split()[0] for f in schema.split(", ")]]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("chunk_no").combine_chunks()
        arrays = {n: table.column(c).to_numpy().astype("<i8").tobytes() for n, c in (("rows", "chunk_no"), ("labels", "label_no"), ("opens", "opens"), ("closes", "closes"))}
        values = {**arrays, **pack(table)}
        return pa.RecordBatch.from_arrays([*[table.column(c).chunk(0).slice(0, 1) for c in on], *[pa.array([values[n]]) for n in names[len(on) :]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        size: dict[tuple, int] = {}
        for batch in batches:
            keys = pa.Table.from_batches([batch.select(on)])
            for group in keys.group_by(on).aggregate([]).to_pylist():
                key = tuple(group[c] for c in on)
                same = [pc.equal(batch.column(c), v) for c, v in zip(on, key)]
                mask = same[0]
                for s in same[1:]:
                    mask = pc.and_(mask, s)
                part = batch.filter(mask)
                while part.num_rows:
                    room = limit - size.get(key, 0)
                    held.setdefault(key, []).append(part.slice(0, room))
                    size[key] = size.get(key, 0) + min(room, part.num_rows)
                    part = part.slice(room)
                    if size[key] >= limit:
                        yield block(held.pop(key))
                        del size[key]
            while sum(size.values()) > 4 * limit:
                key = max(size, key=size.get)
                yield block(held.pop(key))
                del size[key]
        for parts in held.values():
            yield block(parts)

    wanted = rows.where(" and ".join(f"{c} is not null" for c in on)).select(*on, "chunk_no", "label_no", *windows(), *payload)
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in on)
    return wanted.mapInArrow(run, f"{types}, {COMMON}, {schema}")


def request_blocks(requests: DataFrame, on: list[str], grants: DataFrame, payload: list[str], block_requests: int | None = None, groups: int = 1) -> DataFrame:
    """Requests (on, request_no, rights_no, as_of, payload) in blocks of about BLOCK_REQUESTS, one row each, with the labels that the rights in a
    block are granted; `groups` is how many groups the rows are dealt over evenly. A request without a time is not bound to windows."""
    blocks = max(1, -(-requests.count() // ((block_requests or BLOCK_REQUESTS) * groups)))
    labels = grants.groupBy("rights_no").agg(F.collect_list("label_no").alias("granted"))  # distinct labels are few
    known = requests.join(broadcast_if_small(labels, 10_000), "rights_no")
    request = F.struct("request_no", "rights_no", micros("as_of").alias("as_of"), *payload)
    dealt = known.withColumn("request_block", F.pmod(F.xxhash64("request_no"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(*on, "request_block").agg(F.collect_list(request).alias("requests"), F.collect_set(F.struct("rights_no", "granted")).alias("rights"))


class Cell:
    """One block of stored rows before one block of requests."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.batch, self.i = batch, i
        self.rows, self.labels, self.opens, self.closes = (self.numbers(c) for c in ("rows", "labels", "opens", "closes"))
        self.requests = batch.column("requests")[i].values

    def numbers(self, column: str, kind: str = "<i8") -> np.ndarray:
        return np.frombuffer(self.batch.column(column)[self.i].as_buffer(), kind)

    def field(self, name: str) -> pa.Array:
        return self.requests.field(name)

    @cached_property
    def granted(self) -> tuple[np.ndarray, np.ndarray]:
        """For every request the place of its rights, and for every such place which rows have a granted label."""
        rights = self.batch.column("rights")[self.i].values
        codes, kinds = np.unique(self.labels, return_inverse=True)
        numbers = rights.field("rights_no").to_numpy(zero_copy_only=False)
        seen = np.stack([np.isin(codes, labels)[kinds] for labels in rights.field("granted").to_pylist()])
        order = np.argsort(numbers)
        return order[np.searchsorted(numbers, self.field("rights_no").to_numpy(zero_copy_only=False), sorter=order)], seen

    @cached_property
    def times(self) -> tuple[np.ndarray, np.ndarray]:
        """Which requests have a time, and the times."""
        as_of = self.field("as_of")
        return as_of.is_valid().to_numpy(zero_copy_only=False), as_of.fill_null(0).to_numpy(zero_copy_only=False)

    def groups(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some requests by their rights, with the places of the rows that these are granted: no other pair has to be scored. Many different
        rights are left together, before all rows."""
        own, seen = self.granted
        kinds = np.unique(own[at])
        if len(kinds) > RIGHTS:
            yield at, np.arange(len(self.rows))
            return
        for kind in kinds.tolist():
            rows = np.flatnonzero(seen[kind])
            if len(rows):
                yield at[own[at] == kind], rows

    def sees(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether request `of` may see row `at`, for arrays that broadcast: a granted label, and a window that holds the time."""
        own, seen = self.granted
        timed, time = self.times
        return seen[own[of], at] & (~timed[of] | ((self.opens[at] <= time[of]) & (time[of] < self.closes[at])))


class Best:
    """The best rows a task has met for the requests of a block: higher scores first, then smaller row numbers."""

    def __init__(self, n: int, requests: np.ndarray) -> None:
        self.n, self.requests = n, np.array(requests)  # a copy: a view would keep the whole Arrow batch it was met in
        self.floor = np.full(len(requests), -np.inf)  # the n-th best score so far
        self.last = np.full(len(requests), np.iinfo(np.int64).max)  # the row that has it
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def least(self, first_row: int) -> np.ndarray:
        """What a score must reach in rows from first_row on: an equal one counts only before the row that has it. Scores have nine digits."""
        return self.floor + np.where(first_row > self.last, HALF_DIGIT, -HALF_DIGIT)

    def add(self, of: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Scored pairs of requests (by place) and rows, or scores of requests `of` x rows, -inf where there is none."""
        if scores.ndim == 2:
            of, rows, scores = (x.ravel() for x in np.broadcast_arrays(of[:, None], rows, scores))
        floor = self.floor[of]
        kept = (scores > floor) | (scores == floor) & (rows < self.last[of]) & (scores > -np.inf)
        self.held.append((of[kept], rows[kept], scores[kept]))
        self.size += int(kept.sum())
        if self.size > min(HELD_ROWS, 2 * self.n * len(self.requests)):
            self.trim()

    def trim(self) -> None:
        if not self.held:
            return
        of, row, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((row, -score, of))
        of, row, score = of[order], row[order], score[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        last = place == self.n - 1
        self.floor[of[last]], self.last[of[last]] = score[last], row[last]
        kept = place < self.n
        self.held = [(of[kept], row[kept], score[kept])]
        self.size = int(kept.sum())

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.trim()
            of, row, score = self.held[0]
            for at in range(0, len(of), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.requests[of[part]]), pa.array(row[part]), pa.array(score[part])], names=["request_no", "chunk_no", "score"])


def best_of_cells(stored: DataFrame, asked: DataFrame, on: list[str], score: Callable[[Cell, Best], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], n: int) -> DataFrame:
    """(request_no, chunk_no, score) with every request's best n per task. `score` takes a cell and the best of its requests so far and gives
    (places of requests, places of rows, scores) of all pairs that may be among them, and of few others; what a request may not see is left
    out here."""
    columns = [f"i.{c}" for c in stored.columns] + ["w.request_block", "w.requests", "w.rights"]
    cells = _met(stored, asked, on).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = Cell(batch, i)
                if not len(cell.rows):
                    continue
                key = tuple(batch.column(c)[i].as_py() for c in [*on, "request_block"])
                if sum(b.size for b in best.values()) > 4 * HELD_ROWS:
                    for b in best.values():
                        b.trim()
                    while sum(b.size for b in best.values()) > 2 * HELD_ROWS:
                        yield from best.pop(next(iter(best))).result()
                if key not in best:
                    best[key] = Best(n, cell.field("request_no").to_numpy(zero_copy_only=False))
                own = best[key]
                fresh = not own.size
                for of, at, scores in score(cell, own):
                    seen = cell.sees(of, at)
                    own.add(of[seen], cell.rows[at[seen]], scores[seen])
                if fresh:
                    own.trim()  # for the floors
        for own in best.values():
            yield from own.result()

    return cells.mapInArrow(run, "request_no long, chunk_no long, score double")


def _met(stored: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """The cells: every stored block (alias i) with every block of requests (alias w) of its group. Few blocks of requests are broadcast; else the
    group's square of cells is dealt to SALTS x DEALS tasks, which differ little in size. Their number is fixed, as cells are small as bytes
    and long as work, so that merging partitions by their bytes would leave a few tasks with everything."""
    if is_small(asked, BROADCAST_BLOCKS):
        return spread_join(asked, stored, on, ["rows"], max_rows=BROADCAST_BLOCKS)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*on, "_salt", "_deal"]
    i = stored.withColumn("_salt", F.pmod(F.xxhash64("rows"), F.lit(SALTS)).cast("int")).withColumn("_deal", number(DEALS))
    w = asked.withColumn("_deal", F.pmod("request_block", F.lit(DEALS)).cast("int")).withColumn("_salt", number(SALTS))
    w, i = (df.repartition(SALTS * DEALS // 2, *keys).alias(name) for df, name in ((w, "w"), (i, "i")))
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"w.{key}") == F.col(f"i.{key}"))
    return w.hint("merge").join(i, same)


def slices(count: int, width: int) -> Iterator[np.ndarray]:
    """Places of requests in groups whose matrix with `width` rows stays bounded."""
    step = max(1, CELLS // max(1, width))
    for at in range(0, count, step):
        yield np.arange(at, min(at + step, count))
