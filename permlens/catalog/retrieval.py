"""Keyword, vector and fused retrieval."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog.sql import h, sql, terms, words
from permlens.functions import models
from permlens.functions import text as T
from permlens.functions.hashing import draw
from permlens.operators import dense, fusion, keyword
from permlens.operators.access import CHUNK
from permlens.operators.metrics import nearest_rank
from permlens.plans import search
from permlens.plans.corpus import Corpus

PROBED = 0.7  # of the cells
HIT = ["request_id", "key", "version_no", "ordinal", "char_start", "char_end", "rank"]


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def hit_rows(df: DataFrame, *more: str) -> DataFrame:
    return longs(df.select(*HIT, *more), "version_no", "ordinal", "char_start", "char_end", "rank")


def scored(df: DataFrame, *more: str) -> DataFrame:
    return hit_rows(df.withColumn("score", F.round("score", 9)), "score", *more)


def x1(c: Corpus) -> DataFrame:
    found = c.given("documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def x1_dictionary(c: Corpus) -> DataFrame:
    docs = c.given("documents")
    return keyword.dictionary_terms(docs, ["doc_id"], "text", keyword.term_dictionary(docs, "text")).drop("term_no")


def x2(c: Corpus) -> DataFrame:
    first = F.sum(F.element_at("positions", 1)).alias("first_positions")
    listed = F.sum(F.aggregate("positions", F.lit(0), lambda a, p: a + p)).alias("positions")
    shape = c.postings.groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("distinct_terms"), F.sum("tf").alias("terms"), first, listed, F.max("n_terms").alias("n_terms")
    )
    named = shape.join(c.candidates.select("chunk_no", "key", "version_no", "ordinal"), "chunk_no").drop("chunk_no")
    return longs(named, "version_no", "ordinal", "first_positions", "positions", "n_terms")


def recorded(c: Corpus) -> DataFrame:
    """The expected rankings: what was retrieved, but for requests drawn to have lost their list or their first place."""
    kept = c.results.where("strategy = 'sparse-only'").withColumn("d", draw("record", F.col("request_id")) % 10)
    return kept.where(~((F.col("d") == 0) | ((F.col("d") == 1) & (F.col("rank") == 1)))).drop("d")


def x5(c: Corpus) -> DataFrame:
    return longs(keyword.ranking_differences(c.results.where("strategy = 'sparse-only'"), recorded(c)), "expected_n", "actual_n")


def x5_status(c: Corpus) -> DataFrame:
    """Recorded rankings of every strategy: one recorded at another k, one configured otherwise, one unchanged, one with the differences of X5."""
    settings = "strategy string, dataset_digest string, k int, configuration string"
    ran = c.spark.createDataFrame([(s, "aa", 10, "one") for s in fusion.STRATEGIES], settings)
    noted = c.spark.createDataFrame([("sparse-only", "aa", 10, "one"), ("dense-only", "aa", 5, "one"), ("hybrid-rrf", "aa", 10, "two"), ("hybrid-rrf-rerank", "aa", 10, "one"), ("retired", "aa", 10, "one")], settings)
    shape = ["strategy", "request_id", "rank", *CHUNK, *keyword.PLACE]
    expected = recorded(c).select(*shape).unionByName(c.results.where("strategy <> 'sparse-only'").select(*shape))
    return keyword.ranking_status(c.results.select(*shape), expected, ran, noted)


def x6(c: Corpus) -> DataFrame:
    return keyword.lexical_overlap(c.cases).withColumn("overlap", F.round("overlap", 6))


def exact(c: Corpus) -> DataFrame:
    return c._once("given_exact", lambda: dense.exact_topk(c.requests_with_given_vectors(), c.given_vectors(), 10))


def near(c: Corpus, filter_first: bool) -> DataFrame:
    """An inverted file over the given vectors: a centre per root of their number, most cells probed, as the given vectors have no clusters."""

    def build() -> DataFrame:
        given = c.given("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        quantiser = dense.fit_quantiser(given, "vec_id", math.ceil(math.sqrt(given.count())))
        probes = math.ceil(PROBED * quantiser.cells)
        return dense.near_topk(c.requests_with_given_vectors(), c.given_vectors(), quantiser, probes, 10, filter_first)

    return c._once(f"given_near_{'before' if filter_first else 'after'}", build)


def d2(c: Corpus) -> DataFrame:
    d = draw("fault", F.col("vec_id").cast("string")) % 10
    v = F.col("embedding")
    broken = (
        F.when(d == 0, F.slice(v, 1, 63))
        .when(d == 1, F.transform(v, lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x)))
        .when(d == 2, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .otherwise(v)
    )
    vectors = c.given("embeddings").select("vec_id", broken.alias("vector"))
    return dense.vector_problems(vectors, 64).select("vec_id", "problem")


def d3(c: Corpus) -> DataFrame:
    counted = dense.word_buckets(c.candidates, F.concat_ws("\n", "section_path", "content"), ["key", "version_no", "ordinal"])
    shape = counted.groupBy("key", "version_no", "ordinal").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("cnt").alias("words"), F.sum(F.col("bucket") * F.col("cnt")).alias("weighted")
    )
    return longs(shape, "version_no", "ordinal")


def d5(c: Corpus) -> DataFrame:
    both = near(c, True).withColumn("filter", F.lit("before")).unionByName(near(c, False).withColumn("filter", F.lit("after")))
    return scored(both, "filter")


def recall_rows(rows: DataFrame) -> DataFrame:
    return longs(rows, "searches", "fewer_results", "empty").withColumns({n: F.round(n, 6) for n in ("recall", "distance_recall")})


def d6(c: Corpus) -> DataFrame:
    """The recall of D5, filtered before and after, and of exact search filtered after."""
    asked, stored = c.requests_with_given_vectors(), c.given_vectors()
    late = c._once("given_unfiltered", lambda: dense.filter_after(asked, stored, 10))
    reports = [dense.ann_recall(exact(c), found, c.scoped, 10, c.scoped).withColumn("run", F.lit(run)) for run, found in (("near", near(c, True)), ("near, filtered after", near(c, False)), ("exact, filtered after", late))]
    return recall_rows(reports[0].unionByName(reports[1]).unionByName(reports[2]).drop("refusal"))


def d6_refused(c: Corpus) -> DataFrame:
    """A candidate run that did not send drawn requests."""
    sent = c.scoped.where(draw("sent", F.col("request_id")) % 50 > 0)
    return recall_rows(dense.ann_recall(exact(c), near(c, True), c.scoped, 10, sent))


def d7(c: Corpus) -> DataFrame:
    spread = exact(c).groupBy("request_id").agg(F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    return nearest_rank(spread, [], "spread", {"spread_p50": 0.5}).select("spread_p50")


def d8(c: Corpus) -> DataFrame:
    profile = F.when(draw("prof", F.col("request_id")) % 20 == 0, "other").otherwise("given")
    asked = c.scoped.select("request_id", profile.alias("profile_id"))
    return dense.profile_guard(asked, c.given_vectors()).select("request_id", "profile_id", "reason")


def f1(c: Corpus) -> DataFrame:
    fused = fusion.rrf_fuse(c.sparse, c.dense).withColumnRenamed("fused_rank", "rank")
    return longs(scored(fused, "sparse_rank", "dense_rank"), "sparse_rank", "dense_rank")


def pool(c: Corpus) -> DataFrame:
    return fusion.dedupe_topk(fusion.rrf_fuse(c.sparse, c.dense), 20, ["request_id"], rank="fused_rank", out="fused_rank")


def f3(c: Corpus) -> DataFrame:
    rows = pool(c)
    reranked = fusion.rerank(rows, search.overlap_scores(rows, c.scoped, c.candidates))
    return longs(hit_rows(reranked.withColumn("rerank_score", F.round("rerank_score", 9)), "rerank_score", "fused_rank"), "fused_rank")


def f4(c: Corpus) -> DataFrame:
    rows = search.overlap_scores(pool(c), c.scoped, c.candidates).withColumn("rerank_score", F.round("rerank_score", 9))
    return longs(rows.select("request_id", "key", "version_no", "ordinal", "rerank_score"), "version_no", "ordinal")


def load_overlap():
    """A plugged-in scorer: the share of a query's words in the passage, in plain Python."""
    import re

    def score(queries: list[str], passages: list[str]) -> list[float]:
        out = []
        for query, passage in zip(queries, passages, strict=True):
            wanted = set(re.findall("[a-z0-9]+", query.lower()))
            found = wanted & set(re.findall("[a-z0-9]+", passage.lower()))
            out.append(round(len(found) / len(wanted), 9) if wanted else 0.0)
        return out

    return score


def u1(c: Corpus) -> DataFrame:
    pairs = search.pool_pairs(pool(c), c.scoped, c.candidates)
    return longs(models.score_pairs(pairs, ["request_id", "key", "version_no", "ordinal"], load_overlap), "version_no", "ordinal")


def f5(c: Corpus) -> DataFrame:
    passages = c.results.where("strategy = 'hybrid-rrf'").join(c.candidates.select(*CHUNK, "word_count"), CHUNK)
    return longs(fusion.fit_query(c.scoped, passages), "longest", "kept_words")


def f6(c: Corpus) -> DataFrame:
    request = F.col("request_id")
    rows = fusion.fall_back(c.scoped.select("request_id"), draw("vec?", request) % 10 > 0, draw("score?", request) % 10 > 0)
    return rows.select("request_id", "strategy", "order_by", F.array_join("reasons", ",").alias("reasons"), "status")


def f7(c: Corpus) -> DataFrame:
    k = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(80)), (draw("k", F.col("request_id")) % 3).cast("int") + 1)
    plans = c.scoped.select(k.alias("k"), F.explode(F.array(*[F.lit(s) for s in fusion.STRATEGIES])).alias("strategy"))
    canonical = fusion.plan_json(F.col("strategy"), F.col("k"))
    counted = plans.select("strategy", "k", fusion.plan_hash(canonical).alias("plan_hash")).groupBy("strategy", "k", "plan_hash")
    return longs(counted.agg(F.count(F.lit(1)).alias("requests")), "k")


QUERIES = {
    "x1_tokenize_terms": x1,
    "x1_term_dictionary": x1_dictionary,
    "x2_build_postings": x2,
    "x3_sparse_topk": lambda c: scored(keyword.sparse_topk(c.scoped, c.posting_blocks, c.candidates, 50)),
    "x4_bm25_topk": lambda c: scored(keyword.bm25_topk(c.scoped, c.postings, c.posting_blocks, c.candidates, 10)),
    "x5_keyword_ranking_check": x5,
    "x5_keyword_ranking_status": x5_status,
    "x6_lexical_overlap_bands": x6,
    "d1_dense_exact_topk": lambda c: scored(dense.exact_topk(c.requests_with_given_vectors(), c.given_vectors(), 10)),
    "d2_validate_vectors": d2,
    "d3_hashing_embedding": d3,
    "d4_dense_sparse_dot_topk": lambda c: scored(dense.sparse_vector_topk(c.scoped, c.candidates, 50)),
    "d5_ann_candidates": d5,
    "d6_ann_recall": d6,
    "d6_ann_recall_refused": d6_refused,
    "d7_score_spread_p50": d7,
    "d8_profile_guard": d8,
    "f1_rrf_fuse": f1,
    "f2_dedupe_overlaps_topk": lambda c: scored(fusion.dedupe_topk(c.sparse, 10, ["request_id"])),
    "f3_rerank_head": f3,
    "f4_word_overlap_score": f4,
    "u1_pluggable_scorer": u1,
    "f5_rerank_query_fit": f5,
    "f6_degraded_fallback": f6,
    "f7_plan_hash": f7,
    "f8_search_all_strategies": lambda c: scored(
        search.all_strategies(c.scoped, c.candidates, c.sparse, c.dense, 10), "strategy"
    ),
}

_HIT = "request_id, key, version_no::BIGINT as version_no, ordinal::BIGINT as ordinal, char_start::BIGINT as char_start, char_end::BIGINT as char_end, rank::BIGINT as rank"

VECTOR_SQL = {
    "vector_count": "select count(*) as total from embeddings",
    "given_vector": f"select k.*, e.embedding::DOUBLE[] as vector from candidate k, (select total from vector_count) n join embeddings e on e.vec_id = {h('vec', "(k.key || ':' || k.ordinal)")} % n.total",
    "given_request": f"select r.*, e.embedding::DOUBLE[] as q_vector from scoped_request r, (select total from vector_count) n join embeddings e on e.vec_id = {h('qvec', 'r.request_id')} % n.total",
    "given_score": "select a.request_id, v.key, v.version_no, v.ordinal, v.char_start, v.char_end, round(list_cosine_similarity(r.q_vector, v.vector), 9) as score from allowed_pair a join given_vector v using (key) join given_request r on r.request_id = a.request_id",
    "given_exact": "select *, row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank from given_score qualify rank <= 10",
    "given_near": "select r.request_id, v.key, v.version_no, v.ordinal, v.char_start, v.char_end, round(list_cosine_similarity(r.q_vector, v.vector), 9) as score, row_number() over (partition by r.request_id order by round(list_cosine_similarity(r.q_vector, v.vector), 9) desc, v.key, v.version_no, v.ordinal) as rank from given_request r, given_vector v qualify rank <= 10",
    "given_after": "select n.* from (select * from given_near) n join allowed_pair a on a.request_id = n.request_id and a.key = n.key",
    "center": f"select embedding::DOUBLE[] as center, row_number() over (order by {h('cell', 'vec_id')}, vec_id) - 1 as cell from embeddings qualify cell < ceil(sqrt((select total from vector_count)))",
    "near_cell": "select vec_id, cell, row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::DOUBLE[], center), 9) desc, cell) as nth from embeddings join center on true",
    "probe": f"select vec_id as q_id, cell from near_cell where nth <= ceil({PROBED}::DOUBLE * (select count(*) from center))",
    "every_pair": f"""
        select r.request_id, k.key, k.version_no, k.ordinal, k.char_start, k.char_end, round(list_cosine_similarity(r.q_vector, k.vector), 9) as score, a.key is not null as allowed, p.cell is not null as probed
        from (select *, {h('qvec', 'request_id')} % (select total from vector_count) as q_id from given_request) r join (select *, {h('vec', "(key || ':' || ordinal)")} % (select total from vector_count) as v_id from given_vector) k on true
        join near_cell c on c.vec_id = k.v_id and c.nth = 1 left join probe p on p.q_id = r.q_id and p.cell = c.cell left join allowed_pair a on a.request_id = r.request_id and a.key = k.key""",
    "enough": "select request_id, count(*) >= 10 as enough from every_pair where allowed and probed group by request_id",
    "near_ranked": """
        select e.* exclude (allowed, probed), 'before' as "filter", row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank
            from every_pair e left join enough using (request_id) where allowed and (probed or not coalesce(enough, false)) qualify rank <= 10
        union all select * exclude (allowed) from (select * exclude (probed, allowed), 'after', row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank, allowed from every_pair where probed qualify rank <= 10) where allowed""",
    "run_result": """
        select 'near' as run, request_id, key, ordinal, score from near_ranked where "filter" = 'before'
        union all select 'near, filtered after', request_id, key, ordinal, score from near_ranked where "filter" = 'after'
        union all select 'exact, filtered after', request_id, key, ordinal, score from given_after""",
    "one_search": """
        select u.run, s.request_id, s.subject, coalesce(expected, 0) as expected, coalesce(found, 0) as found, coalesce(returned, 0) as returned, least(coalesce(expected, 0), coalesce(near, 0)) as near
        from scoped_request s join (select distinct run from run_result) u on true
        left join (select request_id, count(*) as expected from given_exact group by all) e on e.request_id = s.request_id
        left join (select run, e.request_id, count(*) as found from given_exact e join run_result g using (request_id, key, ordinal) group by all) f on f.request_id = s.request_id and f.run = u.run
        left join (select run, g.request_id, count(*) as returned, count(*) filter (g.score >= t.threshold) as near from run_result g
            left join (select request_id, min(score) - 1e-6 as threshold from given_exact group by all) t using (request_id) group by all) n on n.request_id = s.request_id and n.run = u.run""",
}

_RECALL = """count(*) as searches, round(case when sum(expected) > 0 then sum(found) / sum(expected) else 1 end, 6) as recall,
    round(case when sum(expected) > 0 then sum(near) / sum(expected) else 1 end, 6) as distance_recall,
    count(*) filter (returned < expected) as fewer_results, count(*) filter (expected > 0 and returned = 0) as empty"""

PLAN_SQL = """'{"strategy":"' || strategy || '","k":' || k || ',"candidates":' || greatest(50, k) || ',"rrfK":' || case when strategy like 'hybrid%' then '60' else 'null' end
    || ',"dedupeOverlaps":true' || case when strategy = 'hybrid-rrf-rerank' then ',"rerankCandidates":' || greatest(20, k) || ',"reranker":"word-overlap"' else '' end
    || case when strategy <> 'dense-only' then ',"sparseContext":true' else '' end || '}'"""
_STRATEGIES = "['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank']"

SQL = {
    "x1_tokenize_terms": f"select doc_id, term, count(*) as n from (select doc_id, unnest({terms('text')}) as term from documents) group by all",
    "x1_term_dictionary": f"select doc_id, term, count(*) as n from (select doc_id, unnest({terms('text')}) as term from documents) group by all",
    "x2_build_postings": sql(
        """select key, version_no::BIGINT as version_no, ordinal, count(*) as distinct_terms, sum(tf)::BIGINT as terms, sum(first)::BIGINT as first_positions,
            sum(positions)::BIGINT as positions, max(n_terms)::BIGINT as n_terms
        from (select key, version_no, ordinal, term, count(*) as tf, min(pos) as first, sum(pos) as positions, max(n_terms) as n_terms from chunk_term group by all) group by all"""
    ),
    "x3_sparse_topk": sql(f"select {_HIT}, round(score, 9) as score from sparse_hit"),
    "x4_bm25_topk": sql(f"select {_HIT}, round(score, 9) as score from bm25_hit"),
    "x5_keyword_ranking_check": sql(
        f"""select 'sparse-only' as strategy, request_id, coalesce(len(want), 0)::BIGINT as expected_n, coalesce(len(got), 0)::BIGINT as actual_n
        from (select request_id, list({{'r': rank, 'k': key, 'v': version_no, 's': char_start, 'e': char_end}} order by rank) as got from sparse_top group by all) a
        full join (select request_id, list({{'r': rank, 'k': key, 'v': version_no, 's': char_start, 'e': char_end}} order by rank) as want from sparse_top
            where not ({h('record', 'request_id')} % 10 = 0 or ({h('record', 'request_id')} % 10 = 1 and rank = 1)) group by all) b using (request_id)
        where got is distinct from want"""
    ),
    "x5_keyword_ranking_status": sql(
        f"""select 'sparse-only' as strategy, 'failed' as status, 'cases ranked differently' as reason, count(distinct request_id) as differences from sparse_top where {h('record', 'request_id')} % 10 <= 1
        union all select 'dense-only', 'failed', 'recorded for another dataset or k', null union all select 'hybrid-rrf', 'not applicable', 'ran with another configuration', null
        union all select 'hybrid-rrf-rerank', 'passed', null, 0"""
    ),
    "x6_lexical_overlap_bands": sql(
        f"""select case_id, round(overlap, 6) as overlap, case when overlap < 1 / 3 then 'low' when overlap >= 2 / 3 then 'high' else 'mid' end as band
        from (select case_id, case when len(q) = 0 then 0 else len(list_intersect(q, e)) / len(q) end as overlap
            from (select case_id, list_distinct({terms('query')}) as q, list_distinct({terms('quote')}) as e from eval_case where answerable))"""
    ),
    "d1_dense_exact_topk": sql(f"select {_HIT}, round(score, 9) as score from given_exact", **VECTOR_SQL),
    "d2_validate_vectors": f"""
        select vec_id, case when d = 0 then 'wrong length' when d = 1 then 'not finite' when d = 2 then 'all zero' end as problem
        from (select vec_id, {h('fault', 'vec_id')} % 10 as d from embeddings) where d < 3""",
    "d3_hashing_embedding": sql(
        """select key, version_no::BIGINT as version_no, ordinal, count(*) as buckets, sum(cnt)::BIGINT as words, sum(bucket * cnt)::BIGINT as weighted from chunk_bucket group by all"""
    ),
    "d4_dense_sparse_dot_topk": sql(
        f"""select {_HIT}, round(score, 9) as score from (select *, row_number() over (partition by request_id order by score desc, key, version_no, ordinal) as rank
            from (select d.* exclude (dot), round(dot / (length * q_length), 9) as score from dot d join chunk_length using (key, ordinal) join request_length using (request_id))
            qualify rank <= 50)"""
    ),
    "d5_ann_candidates": sql(f'select {_HIT}, "filter", score from near_ranked', **VECTOR_SQL),
    "d6_ann_recall": sql(f"select run, coalesce(subject, 'all') as subject, {_RECALL} from one_search group by grouping sets ((run, subject), (run))", **VECTOR_SQL),
    "d6_ann_recall_refused": sql(
        f"""select 'all' as subject, count(*) as searches, null::DOUBLE as recall, null::DOUBLE as distance_recall, null::BIGINT as fewer_results, null::BIGINT as empty, 'the runs sent different searches' as refusal
        from scoped_request where {h('sent', 'request_id')} % 50 = 0"""
    ),
    "d7_score_spread_p50": sql(
        """select spread as spread_p50 from (select spread, row_number() over (order by spread) as n, count(*) over () as total
            from (select round(max(score) - min(score), 6) as spread from given_exact group by request_id)) where n = least(total - 1, floor(total * 0.5)) + 1""",
        **VECTOR_SQL,
    ),
    "d8_profile_guard": sql(
        f"select request_id, 'other' as profile_id, 'dense_index_mismatch' as reason from scoped_request where {h('prof', 'request_id')} % 20 = 0"
    ),
    "f1_rrf_fuse": sql(
        f"select {_HIT.replace('rank::BIGINT as rank', 'fused_rank::BIGINT as rank')}, round(score, 9) as score, sparse_rank::BIGINT as sparse_rank, dense_rank::BIGINT as dense_rank from fused"
    ),
    "f2_dedupe_overlaps_topk": sql(f"select {_HIT}, round(score, 9) as score from sparse_top"),
    "f3_rerank_head": sql(f"select {_HIT}, round(rerank_score, 9) as rerank_score, fused_rank::BIGINT as fused_rank from reranked"),
    "f4_word_overlap_score": sql(
        "select request_id, key, version_no::BIGINT as version_no, ordinal::BIGINT as ordinal, round(rerank_score, 9) as rerank_score from reranked"
    ),
    "u1_pluggable_scorer": sql(
        "select request_id, key, version_no::BIGINT as version_no, ordinal::BIGINT as ordinal, round(rerank_score, 9) as rerank_score from reranked"
    ),
    "f5_rerank_query_fit": sql(
        f"""select request_id, longest, case when fits then len(w) else room end::BIGINT as kept_words, case when fits then query else array_to_string(w[1:room], ' ') end as fitted,
            not fits as truncated, not fits and room < 1 as refused
        from (select request_id, query, longest, regexp_extract_all(query, '\\S+') as w, {words('query')} <= greatest(509 - longest, 0) as fits, greatest(509 - longest, 0) as room
            from scoped_request join (select t.request_id, max(k.word_count) as longest from hybrid_top t join candidate k using (key, ordinal) group by all) using (request_id))"""
    ),
    "f6_degraded_fallback": sql(
        f"""select request_id, strategy, order_by, reasons, case when order_by is null then 'failed' when reasons <> '' then 'degraded' else 'ok' end as status from (
            select *, case when strategy = 'sparse-only' then 'sparse' when strategy = 'dense-only' then case when v then 'dense' end
                    when strategy = 'hybrid-rrf-rerank' and s then 'rerank' when v then 'fused' else 'sparse' end as order_by,
                concat_ws(',', case when strategy like 'hybrid%' and not v then 'dense_unavailable' end, case when strategy = 'hybrid-rrf-rerank' and not s then 'rerank_unavailable' end) as reasons
            from (select request_id, unnest({_STRATEGIES}) as strategy, {h('vec?', 'request_id')} % 10 > 0 as v, {h('score?', 'request_id')} % 10 > 0 as s from scoped_request))"""
    ),
    "f7_plan_hash": sql(
        f"""select strategy, k::BIGINT as k, substr(sha256({PLAN_SQL}), 1, 16) as plan_hash, count(*) as requests
        from (select unnest({_STRATEGIES}) as strategy, ([5, 10, 80])[({h('k', 'request_id')} % 3 + 1)::INT] as k from scoped_request) group by all"""
    ),
    "f8_search_all_strategies": sql(f"select {_HIT}, strategy, round(score, 9) as score from result"),
}
