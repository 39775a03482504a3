"""The vector channel: exact cosine search, hashed word vectors, approximate candidates and their recall."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.functions import text as T
from permlens.functions.hashing import draw
from permlens.operators.access import CHUNK, LABELS, SCOPE
from permlens.operators.blocks import CELLS, Best, Cell, best_of_cells, request_blocks, slices, stored_blocks
from permlens.operators.keyword import PLACE, context_text, label_table, named_top, rights_grants, top
from permlens.session import broadcast_if_small, written

BUCKETS = 384
VECTOR_ROWS = 4096  # of a block
SCORE_TOLERANCE = 1e-6
SAMPLE_VECTORS = 20_000  # a quantiser is fitted on, at most
MAX_CELLS = 4096


VECTOR_BLOCK = "vectors binary"


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """Stored vectors (tenant_id, profile_id, chunk_no, label_no, window, vector) in blocks of one tenant and profile."""
    return stored_blocks(vectors, ["tenant_id", "profile_id"], ["vector"], _pack_vectors, VECTOR_BLOCK, VECTOR_ROWS)


def _pack_vectors(table: pa.Table) -> dict:
    return {"vectors": table.column("vector").combine_chunks().flatten().to_numpy().astype("<f4").tobytes()}


def _cosine(cell: Cell, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block products of the request vectors with a block's vectors."""
    return _cosine_of(cell, best, np.arange(len(best.floor)))


def _probed_cosine(cell: Cell, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Likewise, for the requests that probe the block's cell of vectors."""
    probes = np.stack([np.frombuffer(p, np.uint8) for p in cell.field("probes").to_pylist()])
    number = cell.batch.column("cell")[cell.i].as_py()
    return _cosine_of(cell, best, np.flatnonzero(probes[:, number >> 3] & (128 >> (number & 7))))


def _cosine_of(cell: Cell, best: Best, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Single-precision products of unit vectors show which pairs can reach a request's n-th best score, within a margin that no rounding
    exceeds; only those are computed in double precision. A vector without a finite length is near to nothing."""
    if not len(asked):
        return
    corpus = cell.numbers("vectors", "<f4").reshape(len(cell.rows), -1)
    queries = cell.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(best.floor), -1)
    width = corpus.shape[1]
    if width != queries.shape[1]:
        raise ValueError("one profile holds vectors of different lengths")
    with np.errstate(all="ignore"):
        (lengths, query_units), (norms, units) = map(_units, (queries, corpus))
    asked = asked[(lengths[asked] > 0) & np.isfinite(lengths[asked])]
    whole = (norms > 0) & np.isfinite(norms)
    margin, step = (width + 8) * 2.0**-24 + 1e-9, max(1, CELLS // max(1, width))
    for group, rows in cell.groups(asked):
        rows = rows[whole[rows]]
        own = units[rows].T
        for part in slices(len(group), len(rows)):
            at = group[part]
            near = query_units[at] @ own
            least = best.least(cell.rows[0])[at] - margin
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and len(rows) > best.n:  # nothing to compare with yet: the block's own n-th best of what may be seen
                seen = np.where(cell.sees(at[fresh][:, None], rows), near[fresh], -np.inf)
                least[fresh] = np.partition(seen, len(rows) - best.n, axis=1)[:, len(rows) - best.n] - 2 * margin
            of, place = np.divmod(np.flatnonzero(near >= least.astype(np.float32)[:, None]), max(1, len(rows)))
            of, place = at[of], rows[place]
            for i in range(0, len(of), step):
                a, b = of[i : i + step], place[i : i + step]
                dots = np.einsum("ij,ij->i", queries[a].astype(np.float64), corpus[b].astype(np.float64))
                yield a, b, np.round(dots / (lengths[a] * norms[b]), 9) + 0.0


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = vectors.astype(np.float64)
    lengths = np.sqrt((wide * wide).sum(1))
    return lengths, (wide / lengths[:, None]).astype(np.float32)


def vector_requests(requests: DataFrame, grants: DataFrame) -> DataFrame:
    asked = requests.select("request_no", "tenant_id", "profile_id", "rights_no", "as_of", F.col("vector").cast("array<float>").alias("vector"))
    return written(request_blocks(asked, ["tenant_id", "profile_id"], grants, ["vector"]), "asked-vectors")


def exact_topk(requests: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Cosine similarity of every request vector with every vector it may see, ranked after the filter. Blocks of stored vectors meet blocks of
    request vectors of the same tenant and profile in tasks; nothing passes through the driver, and the plan is the same for any number
    of requests. Ties are kept in chunk order, so the result is exact."""
    asked = vector_requests(requests, written(rights_grants(requests, label_table(vectors)), "grants"))
    best = best_of_cells(vector_blocks(vectors), asked, ["tenant_id", "profile_id"], _cosine, n)
    return named_top(best, vectors, requests, n)


def filter_after(requests: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """The nearest n of all rows, of which those the principal may see are kept: what a forced index scan does, and why it returns too
    few. For measuring only; it is not a way to search."""
    asked, everything, granted = _unrestricted(requests, vectors)
    best = best_of_cells(vector_blocks(everything), vector_requests(asked, granted), ["tenant_id", "profile_id"], _cosine, n)
    return visible_hits(top(best, ["request_no"], [F.desc("score"), F.col("chunk_no")], n), requests, vectors)


def _unrestricted(requests: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests and rows of one nameless tenant, and the grant by which all may see all."""
    one = F.lit(0).cast("bigint")
    open_to_all = requests.withColumns({"tenant_id": F.lit(""), "rights_no": one, "as_of": F.lit(None).cast("timestamp")})
    everything = vectors.withColumns({"tenant_id": F.lit(""), "label_no": one, "valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    granted = requests.sparkSession.range(1).select(one.alias("rights_no"), one.alias("label_no"))
    return open_to_all, everything, granted


def visible_hits(hits: DataFrame, requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Those of ranked (request_no, chunk_no, score, rank) that the request may see, with the chunks' keys and places."""
    grants = broadcast_if_small(rights_grants(requests, label_table(vectors)))
    about = hits.join(vectors.select("chunk_no", *CHUNK, *PLACE, "label_no", "valid_from", "valid_to"), "chunk_no")
    asked = about.join(broadcast_if_small(requests.select("request_no", "request_id", "rights_no", "as_of")), "request_no")
    timely = F.col("as_of").isNull() | (F.coalesce(F.col("valid_from") <= F.col("as_of"), F.lit(True)) & F.coalesce(F.col("as_of") < F.col("valid_to"), F.lit(True)))
    return asked.where(timely).join(grants, ["rights_no", "label_no"], "left_semi").select("request_id", *CHUNK, *PLACE, "score", "rank")


def bucket(word: Column) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def word_buckets(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """The hashed word vector of a text as (bucket, count) rows: the deterministic stand-in for an embedding model."""
    exploded = df.select(*keys, F.explode(T.plain_words(text)).alias("word"))
    return exploded.groupBy(*keys, bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def dense_array(counts: Column) -> Column:
    """A map of bucket counts as an array of all buckets."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("float"))


def bucket_maps(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Hashed word vectors as arrays: counted by grouping, so a long text costs no more than its words."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("cnt").cast("int"))))
    return word_buckets(df, text, keys).groupBy(*keys).agg(dense_array(entries).alias("vector"))


def with_vectors(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Rows with the hashed word vector of their text; one without words is left out. The vectors are wide and are guessed small, so that the join
    by shuffling is asked for: they would be broadcast whole."""
    return df.join(bucket_maps(df, text, keys).hint("merge"), keys)


def sparse_vector_topk(requests: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Cosine similarity of hashed word vectors, as block products like any other vector: with a few hundred buckets, meeting on equal buckets
    would make more rows than there are pairs. What shares no bucket with a request is no result."""
    about = [*CHUNK, *PLACE, *LABELS, *SCOPE, "label_no", "chunk_no"]
    stored = with_vectors(chunks, context_text(), CHUNK).select(*about, "vector").withColumn("profile_id", F.lit("hashing"))
    asked = with_vectors(requests, F.col("query"), ["request_id"]).withColumn("profile_id", F.lit("hashing"))
    return exact_topk(written(asked, "sparse-requests"), written(stored, "sparse-vectors"), n).where("score > 0")


def vector_problems(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors a search must not see: wrong length, not finite, all zero."""
    v = F.col("vector")
    not_finite = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(v.isNull() | (F.size(v) != dimension), "wrong length")
        .when(not_finite, "not finite")
        .when(F.forall(v, lambda x: x == 0), "all zero")
    )
    return vectors.withColumn("problem", problem).where("problem is not null")


@dataclass
class Quantiser:
    """Cells of vectors by their nearest centre, by cosine; equal cosines go to the smaller cell."""

    centres: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)

    def _ordered(self, vectors: pd.Series) -> np.ndarray:
        """Every vector's cells, nearest first."""
        unit = self.centres / np.linalg.norm(self.centres, axis=1, keepdims=True)
        v = np.stack(vectors.to_numpy()).astype(np.float64)
        cosine = np.round(v @ unit.T / np.linalg.norm(v, axis=1, keepdims=True), 9)
        return np.argsort(-cosine, axis=1, kind="stable")

    def nearest(self, n: int):
        """A column function: the n nearest cells of a vector, nearest first."""

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series) -> pd.Series:
            return pd.Series(list(self._ordered(vectors)[:, :n].astype(np.int32)))

        return cells

    def probes(self, first: int, last: int):
        """A column function: a bit for every cell, set where it is among the first to last nearest ones (from 0, the last left out)."""

        @F.pandas_udf("binary")
        def probes(vectors: pd.Series) -> pd.Series:
            order = self._ordered(vectors)
            bits = np.zeros(order.shape, bool)
            np.put_along_axis(bits, order[:, first:last], True, axis=1)
            return pd.Series([b.tobytes() for b in np.packbits(bits, axis=1)])

        return probes


def fit_quantiser(vectors: DataFrame, key: str, cells: int, rounds: int = 0, sample: int = SAMPLE_VECTORS) -> Quantiser:
    """The coarse quantiser of an inverted file: the centres are the vectors with the smallest draws, moved by `rounds` of spherical k-means
    over a sample of at most `sample` vectors, drawn likewise (bounded by parameter; every row is indexed all the same)."""
    cells = max(1, min(cells, MAX_CELLS))
    drawn = vectors.select(draw("cell", F.col(key).cast("string")).alias("d"), F.col(key).alias("k"), "vector").orderBy("d", "k").limit(max(cells, sample if rounds else cells))
    found = drawn.toArrow().column("vector").to_pylist()  # bounded: MAX_CELLS or `sample` vectors
    rows = np.array(found, np.float64).reshape(len(found), -1)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True) if len(rows) else rows
    centres = unit[:cells]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return Quantiser(centres if rounds else rows[:cells])


def near_topk(requests: DataFrame, vectors: DataFrame, quantiser: Quantiser, probes: int, n: int, filter_first: bool = True) -> DataFrame:
    """Approximate search by an inverted file: every stored vector lies in the cell of its nearest centre, blocks hold vectors of one cell, and
    a request's vector meets the blocks of its `probes` nearest cells, as block products. A request is one row whatever it probes: its
    cells travel as bits. With filter_first only rows the principal may see are ranked, and a request that finds fewer than n searches its
    other cells too, so a narrow principal gets all there is; otherwise the filter comes last, and too few may be left."""
    group = ["tenant_id", "profile_id"]
    asked = requests
    if not filter_first:
        asked, vectors_in, grants = _unrestricted(requests, vectors)
    else:
        vectors_in, grants = vectors, written(rights_grants(requests, label_table(vectors)), "grants")
    in_cells = vectors_in.withColumn("cell", quantiser.nearest(1)("vector")[0]).hint("rebalance", "cell")  # whole blocks of each cell
    stored = written(stored_blocks(in_cells, [*group, "cell"], ["vector"], _pack_vectors, VECTOR_BLOCK, VECTOR_ROWS), "cells")
    about = asked.select("request_no", *group, "rights_no", "as_of", F.col("vector").cast("array<float>").alias("vector"))
    about = written(about, "asked-cells")

    def search(some: DataFrame, first: int, last: int) -> DataFrame:
        blocks = request_blocks(some.withColumn("probes", quantiser.probes(first, last)("vector")), group, grants, ["vector", "probes"])
        return best_of_cells(stored, written(blocks, "asked-blocks"), group, _probed_cosine, n)

    best = written(top(search(about, 0, probes), ["request_no"], [F.desc("score"), F.col("chunk_no")], n), "near")
    if filter_first and probes < quantiser.cells:
        enough = best.groupBy("request_no").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= n)
        short = written(about.join(enough, "request_no", "left_anti"), "asked-short")
        best = best.drop("rank").unionByName(search(short, probes, quantiser.cells))
    return named_top(best.drop("rank"), vectors, requests, n) if filter_first else visible_hits(best, requests, vectors)


def ann_recall(exact: DataFrame, candidate: DataFrame, searches: DataFrame, k: int, candidate_searches: DataFrame | None = None) -> DataFrame:
    """Recall of approximate results per principal and over all: by identity, by distance (at least as close as the exact k-th, within
    a tolerance), searches with fewer results, searches left empty. Runs that did not send the same searches are not compared: one
    row with the reason and the number of searches that only one of them sent."""
    e = exact.where(F.col("rank") <= k)
    c = candidate.where(F.col("rank") <= k)
    kth = e.groupBy("request_id").agg(F.count(F.lit(1)).alias("expected"), (F.min("score") - SCORE_TOLERANCE).alias("threshold"))
    found = e.join(c.select("request_id", *CHUNK), ["request_id", *CHUNK], "left_semi").groupBy("request_id").agg(F.count(F.lit(1)).alias("found"))
    near = (
        c.join(kth, "request_id", "left").groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("returned"), F.count_if(F.col("score") >= F.col("threshold")).alias("near"))
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    per_search = (
        searches.select("request_id", "subject").join(kth, "request_id", "left").join(found, "request_id", "left").join(near, "request_id", "left")
        .select(
            "subject", zero("expected").alias("expected"), zero("found").alias("found"), zero("returned").alias("returned"),
            F.least(zero("expected"), zero("near")).alias("near"),
        )
    )
    share = lambda name: F.when(F.sum("expected") > 0, F.sum(name) / F.sum("expected")).otherwise(F.lit(1.0))
    report = per_search.rollup("subject").agg(
        F.count(F.lit(1)).alias("searches"),
        share("found").alias("recall"),
        share("near").alias("distance_recall"),
        F.count_if(F.col("returned") < F.col("expected")).alias("fewer_results"),
        F.count_if((F.col("expected") > 0) & (F.col("returned") == 0)).alias("empty"),
    ).withColumn("subject", F.coalesce("subject", F.lit("all"))).withColumn("refusal", F.lit(None).cast("string"))
    if candidate_searches is None:
        return report
    sides = searches.select("request_id", "subject", F.lit(1).alias("side")).unionByName(candidate_searches.select("request_id", "subject", F.lit(2).alias("side")))
    one_sided = sides.groupBy("request_id", "subject").agg(F.countDistinct("side").alias("sides")).agg(F.count_if(F.col("sides") == 1).alias("differing"))
    none = {c: F.lit(None).cast(report.schema[c].dataType) for c in ("recall", "distance_recall", "fewer_results", "empty")}
    refused = one_sided.where("differing > 0").select(F.lit("all").alias("subject"), F.col("differing").alias("searches"), F.lit("the runs sent different searches").alias("refusal")).withColumns(none)
    same = one_sided.where("differing = 0").select(F.col("differing").alias("_same"))  # one row or none
    return report.withColumn("_same", F.lit(0).cast("bigint")).join(F.broadcast(same), "_same", "left_semi").drop("_same").unionByName(refused)


def profile_guard(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Requests whose profile no stored vector has, with the reason their vector channel is left out."""
    known = vectors.select("profile_id").distinct()
    return requests.join(broadcast_if_small(known), "profile_id", "left_anti").withColumn("reason", F.lit("dense_index_mismatch"))
