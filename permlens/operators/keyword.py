"""The keyword channel: terms, postings, term-count and BM25 ranking under authorization."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from permlens.functions import labels as L
from permlens.functions import text as T
from permlens.operators.access import ACCESS_LABEL, CHUNK, PRINCIPAL, label_key
from permlens.operators.blocks import CELLS, HALF_DIGIT, Best, Cell, best_of_cells, request_blocks, slices, stored_blocks
from permlens.operators.spread import spread_join
from permlens.operators.sweep import counts_at
from permlens.session import broadcast_if_small, is_small, written

# The BM25 constants and the bounds of the lexical-overlap bands.
BM25_K1, BM25_B = 1.2, 0.75
LOW_OVERLAP_BELOW, HIGH_OVERLAP_FROM = 1 / 3, 2 / 3

POSTING_ROWS = 256  # chunks whose postings are made at a time
BROADCAST_TERMS = 100_000  # of requests: a table of strings that the driver builds
BOUND_SLACK = 1e-6  # more than rounding can add to a bound
SUM_SLACK = 1e-10  # and to the last digit of a sum

PLACE = ["char_start", "char_end"]
TIES = ["key", "version_no", "ordinal"]


def top(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. Written as a bounded row_number, so every task trims its rows before the shuffle."""
    ranked = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= n)


def number_chunks(chunks: DataFrame, with_context: bool = True) -> DataFrame:
    """Chunks in (key, version, ordinal) order with a number that keeps that order, their term count, and the number of their access labels
    (tenant, labels and regions; the validity window stays with the chunk). Channels carry these numbers instead of the keys, and ties
    between scores go to the smaller chunk number. The result has to be written once, so that the numbers stay."""
    keyed = chunks.withColumn("label_key", label_key(ACCESS_LABEL))
    labels = written(keyed.select("label_key").distinct().withColumn("label_no", F.monotonically_increasing_id()), "label")
    spread = keyed.join(F.broadcast(labels) if is_small(labels) else labels, "label_key").drop("label_key")
    ordered = spread.repartitionByRange(*TIES).sortWithinPartitions(*TIES)
    # terms are made after the parts are found, as what stands before them runs twice: once to sample the parts' bounds
    return ordered.withColumns({"n_terms": F.size(T.terms(context_text(with_context))), "chunk_no": F.monotonically_increasing_id()})


def context_text(with_context: bool = True) -> Column:
    return F.concat_ws("\n", "section_path", "content") if with_context else F.col("content")


def label_table(chunks: DataFrame) -> DataFrame:
    """The access labels in use, by number."""
    return chunks.select("label_no", *ACCESS_LABEL).dropDuplicates(["label_no"])


def postings(chunks: DataFrame, with_context: bool = True) -> DataFrame:
    """(term, chunk, tf, positions) of numbered chunks, with the chunk's term count, label number and window. Ordered by term and chunk across
    range partitions: a common term spreads over several of them, and a lookup prunes by file statistics."""
    about = chunks.select("chunk_no", "label_no", "tenant_id", "n_terms", "valid_from", "valid_to", T.terms(context_text(with_context)).alias("terms"))
    kept = about.drop("terms").schema
    counted = about.mapInArrow(_chunk_postings, StructType([StructField("term", StringType()), *kept.fields, StructField("tf", IntegerType()), StructField("positions", ArrayType(IntegerType()))]))
    return counted.repartitionByRange("term", "chunk_no").sortWithinPartitions("term", "chunk_no")


def _chunk_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each row's terms, the last column, beside the row's others. A chunk's terms stand in one row, so nothing is grouped by
    a shuffle."""
    for part in (batch.slice(at, POSTING_ROWS) for batch in batches for at in range(0, batch.num_rows, POSTING_ROWS)):
        listed = part.column(part.num_columns - 1)
        lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lengths)), lengths)
        pair = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.argsort(pair, kind="stable")  # positions stay in order
        starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        place = order - np.repeat(np.cumsum(lengths) - lengths, lengths)[order]
        first = order[starts]
        own = part.select(range(part.num_columns - 1)).take(pa.array(row[first]))
        ends = np.append(starts, len(pair)).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(coded.indices.take(pa.array(first))), *own.columns, pa.array(np.diff(ends)), positions], names=["term", *own.schema.names, "tf", "positions"]
        )


def term_dictionary(texts: DataFrame, text: str, load_stemmer: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """word, term, term_no of every word of a text column that is no stop word, made once per distinct word. The stemmer is the published one
    or a user's, loaded once per task, which takes and gives lists of words; a word it makes empty has no term. Numbers are the terms',
    in no order. Written, so that the numbers stay."""
    words = texts.select(F.explode(T.plain_words(F.col(text))).alias("word")).distinct().where(~F.col("word").isin(*T.STOPWORDS))
    if load_stemmer is None:
        stemmed = words.withColumn("term", T.stem(F.col("word")))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stem = load_stemmer()
            for batch in batches:
                found = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(stem(found), pa.string())], names=["word", "term"])

        stemmed = words.mapInArrow(run, "word string, term string").where("term <> ''")
    stemmed = written(stemmed, "stems")
    numbers = written(stemmed.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id()), "terms")
    return written(stemmed.join(broadcast_if_small(numbers), "term"), "dictionary")


def dictionary_terms(texts: DataFrame, keys: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """(keys, term, term_no, n) of every text's words, by the dictionary. Words are counted per text before they meet it, and a word that many
    texts have is spread over tasks."""
    counted = texts.select(*keys, F.explode(T.plain_words(F.col(text))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    met = spread_join(dictionary, counted, ["word"], keys)
    return met.groupBy(*[F.col(f"i.{k}").alias(k) for k in keys], "w.term", "w.term_no").agg(F.sum("i.n").alias("n"))


POSTING_BLOCK = "n_terms binary, terms array<string>, starts binary, places binary, tf binary, most binary, least binary"


def posting_blocks(chunks: DataFrame, with_context: bool = True) -> DataFrame:
    """The index that searches read: blocks of chunks of one tenant in chunk order, with every term's postings in the block (place of the chunk and
    tf), and of each term the largest tf and the shortest chunk, which bound what it can add to any score there."""
    rows = chunks.select("tenant_id", "chunk_no", "label_no", "valid_from", "valid_to", T.terms(context_text(with_context)).alias("terms"))
    return stored_blocks(rows, ["tenant_id"], ["terms"], _pack_postings, POSTING_BLOCK)


def _pack_postings(table: pa.Table) -> dict:
    listed = table.column("terms").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy().astype(np.int64)
    coded = listed.flatten().dictionary_encode()
    n = max(1, len(lengths))
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    code, place = pair // n, pair % n
    starts = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
    most = np.maximum.reduceat(tf, starts[:-1]) if len(tf) else tf
    least = np.minimum.reduceat(lengths[place], starts[:-1]) if len(tf) else tf
    packed = {"n_terms": lengths, "starts": starts, "places": place, "tf": tf, "most": most, "least": least}
    return {"terms": coded.dictionary.to_pylist()} | {k: v.astype("<i4").tobytes() for k, v in packed.items()}


def number_requests(requests: DataFrame) -> DataFrame:
    """Requests with a number, the number of their rights (what decides over labels: attributes and region, and whether time and region bind at
    all) and of their scope (rights and time). The result has to be written once, so that the numbers stay."""
    keyed = requests.withColumn("rights_key", label_key([*PRINCIPAL, "region", F.col("as_of").isNull().alias("untimed")]))
    rights = written(keyed.select("rights_key").distinct().withColumn("rights_no", F.monotonically_increasing_id()), "rights")
    numbered = keyed.join(F.broadcast(rights) if is_small(rights) else rights, "rights_key").drop("rights_key")
    scopes = written(numbered.select("rights_no", "as_of").distinct().withColumn("scope_no", F.monotonically_increasing_id()), "scope").alias("s")
    near = F.broadcast(scopes) if is_small(scopes) else scopes
    same = (F.col("n.rights_no") == F.col("s.rights_no")) & F.col("n.as_of").eqNullSafe(F.col("s.as_of"))
    return numbered.alias("n").join(near, same).select("n.*", "s.scope_no").withColumn("request_no", F.monotonically_increasing_id())


def rights_grants(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """(rights, access label) pairs that may meet: the access rule and the region rule, applied once per distinct pair, whatever the number of
    requests and times. Windows are held against times where rows are counted or scored."""
    rights = requests.select("rights_no", *PRINCIPAL, "region", F.col("as_of").isNull().alias("untimed")).dropDuplicates(["rights_no"])
    return rights.alias("w").join(labels.alias("i"), L.authorized("w", "i") & L.in_region("w", "i")).select("rights_no", "label_no")


def named_top(best: DataFrame, chunks: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """The first n of every request over all tasks, with the chunks' keys and places and the requests' ids."""
    ranked = top(best, ["request_no"], [F.desc("score"), F.col("chunk_no")], n)
    return (
        ranked.join(chunks.select("chunk_no", *CHUNK, *PLACE), "chunk_no")
        .join(broadcast_if_small(requests.select("request_no", "request_id")), "request_no")
        .select("request_id", *CHUNK, *PLACE, "score", "rank")
    )


def _term_scores(gain, digits_of, raw_of) -> Callable[[Cell, Best], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Term-at-a-time scoring of a cell. What a request's terms could add at most in the block decides whether it is scored there at all; a
    request whose bound lies below its n-th best score so far is passed over, and only sums that can reach it are looked at. gain(weight,
    slope, tf, length) must grow with tf and shrink with the length; raw_of gives the sum whose digits_of is a score. A gain of None is tf."""

    def score(cell: Cell, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asked = cell.field("terms")
        flat = asked.flatten()
        of = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
        term = pc.fill_null(pc.index_in(flat.field("term"), value_set=cell.batch.column("terms")[cell.i].values), -1).to_numpy()
        known = term >= 0
        of, term = of[known], term[known]
        weight, slope = (flat.field(c).to_numpy(zero_copy_only=False)[known] for c in ("weight", "slope"))
        lengths, starts, places, tf, most, least = (cell.numbers(c, "<i4") for c in ("n_terms", "starts", "places", "tf", "most", "least"))
        bound = np.bincount(of, gain(weight, slope, most[term], least[term]) if gain else most[term], len(asked))
        needed = raw_of(np.maximum(best.least(cell.rows[0]), HALF_DIGIT))  # more than nothing
        width = len(cell.rows)
        live = np.flatnonzero(bound >= needed - BOUND_SLACK)
        for group in slices(len(live), width):
            at = live[group]
            own = np.full(len(asked), -1)
            own[at] = np.arange(len(at))
            pairs = np.flatnonzero(own[of] >= 0)
            total = np.zeros(len(at) * width)
            count = starts[term[pairs] + 1] - starts[term[pairs]]
            ends = np.cumsum(count)
            cuts = [0, *np.flatnonzero(np.diff(ends // CELLS)) + 1, len(pairs)]  # of bounded numbers of postings
            for lo, hi in zip(cuts, cuts[1:]):
                some, n = pairs[lo:hi], count[lo:hi]
                posting = np.repeat(starts[term[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                place = places[posting]
                added = gain(np.repeat(weight[some], n), np.repeat(slope[some], n), tf[posting], lengths[place]) if gain else tf[posting]
                total += np.bincount(np.repeat(own[of[some]], n) * width + place, added, len(total))
            found = np.flatnonzero(total.reshape(len(at), width) >= (needed[at] - SUM_SLACK)[:, None])
            scores = digits_of(total[found])
            row, place = np.divmod(found, width)
            kept = scores > 0
            yield at[row[kept]], place[kept], scores[kept]

    return score


def _okapi(weight, slope, tf, length, flat: float = BM25_K1 * (1 - BM25_B)):
    return weight * tf / (tf + flat + slope * length)


def asked_terms(requests: DataFrame, weighted: DataFrame, grants: DataFrame) -> DataFrame:
    """Blocks of requests with their weighted terms (request_no, term, weight, slope). The requests with their terms are written first, as they
    are counted before they are dealt to blocks."""
    listed = weighted.groupBy("request_no").agg(F.collect_list(F.struct("term", "weight", "slope")).alias("terms"))
    about = written(requests.select("request_no", "tenant_id", "rights_no", "as_of").join(listed, "request_no"), "listed-terms")
    return written(request_blocks(about, ["tenant_id"], grants, ["terms"]), "asked-terms")


def sparse_topk(requests: DataFrame, blocks: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Any query term may match; the score counts matched positions of distinct query terms and uses no corpus statistics. blocks are the
    posting blocks of the chunks."""
    one = F.lit(1.0)
    wanted = requests.select("request_no", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"), one.alias("weight"), one.alias("slope"))
    score = _term_scores(None, lambda total: np.round(total * 0.1, 9), lambda scores: scores * 10)
    grants = written(rights_grants(requests, label_table(chunks)), "grants")
    best = best_of_cells(blocks, asked_terms(requests, wanted, grants), ["tenant_id"], score, n)
    return named_top(best, chunks, requests, n)


def bm25_topk(requests: DataFrame, index: DataFrame, blocks: DataFrame, chunks: DataFrame, n: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Okapi BM25 whose statistics are those of the chunks each request may see. Chunks and document frequencies are counted per access label
    and, where chunks have windows, by a sweep along their boundaries; only those counts meet the requests' scopes, never the chunks.
    index are the postings, blocks the posting blocks of the chunks. Every step is written, so that no plan holds another's steps: the driver
    keeps and compiles one short plan at a time."""
    grants = written(rights_grants(requests, label_table(chunks)), "grants")
    scopes = requests.select("scope_no", "rights_no", "as_of").dropDuplicates(["scope_no"])
    window = ["valid_from", "valid_to"]
    by_label = written(chunks.groupBy("label_no", *window).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_terms").alias("terms")), "bm25-labels")
    held = written(scopes.join(broadcast_if_small(grants), "rights_no"), "bm25-held")
    counted = written(counts_at(by_label, held.select("label_no", "as_of").distinct(), ["label_no"], ["chunks", "terms"]), "bm25-counted")
    at = lambda df, other, keys: df.alias("h").join(other.alias("c"), _same(keys) & F.col("h.as_of").eqNullSafe(F.col("c.as_of")))
    sizes = at(held, counted, ["label_no"]).groupBy("h.scope_no").agg(F.sum("c.chunks").alias("n"), F.sum("c.terms").alias("terms"))
    sizes = written(sizes.where("n > 0").select("scope_no", "n", (F.col("terms") / F.col("n")).alias("average")), "bm25-sizes")
    asked = requests.select("request_no", "scope_no", "tenant_id", F.explode(T.terms(F.col("query"))).alias("term"))
    counts = written(asked.groupBy("request_no", "scope_no", "tenant_id", "term").agg(F.count(F.lit(1)).alias("asked")), "bm25-counts")
    terms = counts.select("tenant_id", "term").distinct()
    per_label = (
        index.join(broadcast_if_small(terms, BROADCAST_TERMS), ["tenant_id", "term"], "left_semi")
        .groupBy("term", "label_no", *window).agg(F.count(F.lit(1)).alias("df"))
    )
    per_label = written(per_label, "bm25-frequencies")
    scope_terms = counts.select("scope_no", "term").distinct().join(broadcast_if_small(held), "scope_no")
    met = written(scope_terms.join(per_label.select("term", "label_no").distinct(), ["term", "label_no"], "left_semi").select("scope_no", "term", "label_no", "as_of"), "bm25-asked")
    frequencies = written(counts_at(per_label, met.select("term", "label_no", "as_of").distinct(), ["term", "label_no"], ["df"]), "bm25-counted")
    frequency = written(at(met, frequencies, ["term", "label_no"]).groupBy("h.scope_no", "h.term").agg(F.sum("c.df").alias("df")).where("df > 0"), "bm25-df")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = counts.join(frequency, ["scope_no", "term"]).join(broadcast_if_small(sizes), "scope_no")
    weighted = weighted.select("request_no", "term", (F.col("asked") * idf * (k1 + 1)).alias("weight"), (k1 * b / F.col("average")).alias("slope"))
    score = _term_scores(partial(_okapi, flat=k1 * (1 - b)), lambda total: np.round(total, 9), lambda scores: scores)
    best = best_of_cells(blocks, asked_terms(requests, weighted, grants), ["tenant_id"], score, n)
    return named_top(best, chunks, requests, n)


def _same(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"h.{k}") == F.col(f"c.{k}") for k in keys])


def ranking_differences(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Requests whose ordered list of (document, version, start, end) is not the recorded one; a list missing on either side differs."""
    place = ["key", "version_no", *PLACE]

    def ordered(df: DataFrame, name: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("rank", *place)))
        return df.groupBy("strategy", "request_id").agg(listed.alias(name))

    both = ordered(results, "got").join(ordered(expected, "want"), ["strategy", "request_id"], "full")
    return both.where(~F.col("got").eqNullSafe(F.col("want"))).select(
        "strategy", "request_id", F.size(F.coalesce("want", F.array())).alias("expected_n"), F.size(F.coalesce("got", F.array())).alias("actual_n")
    )


def ranking_status(results: DataFrame, expected: DataFrame, ran: DataFrame, recorded: DataFrame) -> DataFrame:
    """passed, failed or not applicable for every strategy with recorded rankings that ran. ran and recorded are (strategy, dataset_digest, k,
    configuration): another dataset or k fails, as the file has to be recorded anew; another configuration is not checked."""
    settings = recorded.alias("e").join(ran.alias("r"), "strategy")
    other = ~F.col("e.dataset_digest").eqNullSafe(F.col("r.dataset_digest")) | ~F.col("e.k").eqNullSafe(F.col("r.k"))
    differing = ranking_differences(results, expected).groupBy("strategy").agg(F.count(F.lit(1)).alias("differences"))
    status = F.when(other, "failed").when(~F.col("e.configuration").eqNullSafe(F.col("r.configuration")), "not applicable").when(F.col("differences") > 0, "failed").otherwise("passed")
    reason = F.when(other, "recorded for another dataset or k").when(status == "not applicable", "ran with another configuration").when(status == "failed", "cases ranked differently")
    checked = ~other & F.col("e.configuration").eqNullSafe(F.col("r.configuration"))
    return settings.join(differing, "strategy", "left").select("strategy", status.alias("status"), reason.alias("reason"), F.when(checked, F.coalesce("differences", F.lit(0))).alias("differences"))


def lexical_overlap(cases: DataFrame) -> DataFrame:
    """The share of a query's distinct terms found in its evidence, with its band."""
    query = F.array_distinct(T.terms(F.col("query")))
    evidence = F.array_distinct(F.flatten(F.transform("evidence", lambda e: T.terms(e["quote"]))))
    share = F.when(F.size("q") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("q", "e")) / F.size("q"))
    band = F.when(F.col("overlap") < LOW_OVERLAP_BELOW, "low").when(F.col("overlap") >= HIGH_OVERLAP_FROM, "high").otherwise("mid")
    return (
        cases.where(F.size("evidence") > 0).withColumn("q", query).withColumn("e", evidence)
        .withColumn("overlap", share).withColumn("band", band).select("case_id", "overlap", "band")
    )
