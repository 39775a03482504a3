import datetime
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from permlens.operators import access, blocks, dense, fusion, keyword, spread
from permlens.operators.access import PRINCIPAL

CHUNKS = (
    "tenant_id string, key string, version_no int, ordinal int, section_path string, content string, char_start int, char_end int, "
    "classification_rank int, allowed_departments array<string>, required_projects array<string>, applies_to_regions array<string>, "
    "valid_from timestamp, valid_to timestamp"
)
REQUESTS = (
    "request_id string, query string, tenant_id string, department string, projects array<string>, clearance_rank int, as_of timestamp, region string"
)
TEXTS = ["gate launch gate", "launch window", "gate", "plain stones", "launch gate window gate", "secret gate gate gate gate"]


def corpus(spark):
    rows = [("t", f"d{i}", 1, 0, "", text, 0, len(text), 3 if "secret" in text else 0, [], [], [], None, None) for i, text in enumerate(TEXTS)]
    rows.append(("u", "z0", 1, 0, "", "gate gate gate gate gate gate", 0, 9, 0, [], [], [], None, None))
    return written(spark, keyword.number_chunks(spark.createDataFrame(rows, CHUNKS)))


def written(spark, df):
    from permlens.session import written as write

    return write(df, "test")


def requests(spark, *queries):
    rows = [(f"r{i}", q, "t", None, [], 0, None, None) for i, q in enumerate(queries)]
    return written(spark, keyword.number_requests(spark.createDataFrame(rows, REQUESTS)))


def test_sparse_counts_matches_after_authorization(spark):
    chunks = corpus(spark)
    got = keyword.sparse_topk(requests(spark, "gate launch gate"), keyword.posting_blocks(chunks), chunks, 3).orderBy("rank").collect()
    assert [(r.key, round(r.score, 1)) for r in got] == [("d0", 0.3), ("d4", 0.3), ("d1", 0.1)]


def index(chunks):
    return keyword.postings(chunks), keyword.posting_blocks(chunks)


def brute_bm25(query, texts, k1=1.2, b=0.75):
    docs = [t.split() for t in texts]
    average = sum(map(len, docs)) / len(docs)
    out = []
    for i, d in enumerate(docs):
        s = 0.0
        for term in query.split():
            tf, df = d.count(term), sum(term in x for x in docs)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / average))
        if s > 0:
            out.append((-round(s, 9), i))
    return [(f"d{i}", -s) for s, i in sorted(out)]


def test_bm25_uses_only_what_the_request_may_see(spark):
    chunks = corpus(spark)
    asked = requests(spark, "gate window gate", "nothing here")
    visible = TEXTS[:5]  # neither the secret chunk nor the other tenant's counts
    got = keyword.bm25_topk(asked, *index(chunks), chunks, 10).where("request_id = 'r0'").orderBy("rank").collect()
    assert [(r.key, round(r.score, 9)) for r in got] == brute_bm25("gate window gate", visible)


def test_large_sides_are_spread_and_give_the_same(spark, monkeypatch):
    chunks = corpus(spark)
    asked = requests(spark, "gate launch", "window")
    few = {tuple(r) for r in keyword.bm25_topk(asked, *index(chunks), chunks, 10).collect()}
    monkeypatch.setattr(spread, "is_small", lambda df, *a: False)
    monkeypatch.setattr(keyword, "is_small", lambda df, *a: False)
    monkeypatch.setattr(keyword, "broadcast_if_small", lambda df, *a: df)
    assert {tuple(r) for r in keyword.bm25_topk(asked, *index(chunks), chunks, 10).collect()} == few


def test_no_plan_holds_pairs_texts_or_one_task(spark):
    """Searches shuffle neither texts nor (request, chunk) pairs: the only rows after scoring are each task's best."""
    chunks = corpus(spark)
    for df in (
        keyword.sparse_topk(requests(spark, "gate"), keyword.posting_blocks(chunks), chunks, 3),
        keyword.bm25_topk(requests(spark, "gate"), *index(chunks), chunks, 3),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian|SinglePartition", plan) and "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("MapInArrow")


def test_every_step_of_a_search_is_a_short_plan(spark, monkeypatch):
    """No written step holds the steps before it: the driver plans and compiles them one at a time, and none runs twice."""
    joins, steps, write = {}, [], keyword.written

    def noted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins[name] = max(joins.get(name, 0), len(re.findall(r"\bJoin \w+", plan)))
        steps.append((name, plan))
        return write(df, name)

    monkeypatch.setattr(keyword, "written", noted)
    monkeypatch.setattr(dense, "written", noted)
    chunks, asked = corpus(spark), requests(spark, "gate launch", "window")
    keyword.bm25_topk(asked, *index(chunks), chunks, 3)
    assert max(joins.values()) <= 6 and joins["asked-terms"] <= 1
    steps.clear()
    dense.sparse_vector_topk(asked, chunks, 3)
    assert all("Generate" not in plan for name, plan in steps if name == "asked-vectors")  # words are split in a step of their own


def timed(spark, seed=4, n_chunks=70, n_requests=40):
    """Chunks with a window each, requests with a time each (some without), several labels and regions."""
    rng = random.Random(seed)
    day = lambda: datetime.datetime(2025, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    chunks = []
    for i in range(n_chunks):
        text = " ".join(rng.choice(["gate", "launch", "window", "stone", "river", "lamp"]) for _ in range(rng.randint(0, 9)))
        chunks.append((rng.choice("tu"), f"d{i:03d}", 1, 0, "", text, 0, len(text), rng.randrange(3), rng.choice([[], ["a"], ["a", "b"]]), rng.choice([[], ["p"]]), rng.choice([[], ["EU"], ["US", "EU"]]), rng.choice([None, day()]), rng.choice([None, day()])))
    asked = [(f"r{i:03d}", " ".join(rng.choice(["gate", "launch", "lamp", "gone"]) for _ in range(rng.randint(0, 4))), rng.choice(["t", "t", "u", None]), rng.choice([None, "a", "b"]), rng.choice([[], ["p", "q"]]), rng.randrange(3), rng.choice([None, day(), day(), day()]), rng.choice([None, "EU", "US"])) for i in range(n_requests)]
    return chunks, asked


def may_see(r, c):
    _, _, tenant, department, projects, clearance, as_of, region = r
    own, classes, departments, required, regions, start, end = c[0], *c[8:]
    right = tenant == own and classes <= clearance and (not departments or department in departments) and (not required or set(required) & set(projects))
    return bool(right) and (as_of is None or (start is None or start <= as_of) and (end is None or as_of < end) and (not regions or region is None or region in regions))


@pytest.mark.parametrize("small", [False, True])
def test_a_time_per_request_and_a_window_per_document(spark, monkeypatch, small):
    if small:  # many blocks of both sides, matrices of a few cells, joins with spread keys
        for module, name, value in ((blocks, "BLOCK_ROWS", 5), (blocks, "BLOCK_REQUESTS", 3), (blocks, "CELLS", 20), (keyword, "CELLS", 4), (blocks, "HELD_ROWS", 7), (blocks, "BROADCAST_BLOCKS", 0)):
            monkeypatch.setattr(module, name, value)
    rows, asked = timed(spark)
    chunks = written(spark, keyword.number_chunks(spark.createDataFrame(rows, CHUNKS).repartition(3)))
    wanted = written(spark, keyword.number_requests(spark.createDataFrame(asked, REQUESTS)))
    sparse, ranked_by_bm25, counts = {}, {}, {}
    for r in asked:
        seen = [c for c in rows if may_see(r, c)]
        terms = set(r[1].split())
        scores = sorted((-sum(w in terms for w in c[5].split()), c[1]) for c in seen)
        sparse[r[0]] = [(k, round(-s * 0.1, 9)) for s, k in scores if s][:4]
        names = [c[1] for c in seen]
        ranked_by_bm25[r[0]] = [(names[int(d[1:])], round(s, 6)) for d, s in brute_bm25(r[1], [c[5] for c in seen])][:4] if any(c[5] for c in seen) else []
        scope = [c for c in rows if c[0] == r[2] and may_see((*r[:3], "a", ["p"], 9, *r[6:]), (*c[:8], 0, [], [], *c[11:]))]
        counts[r[0]] = (len(scope), len(seen))
    got = {r[0]: [] for r in asked}
    for r in keyword.sparse_topk(wanted, keyword.posting_blocks(chunks), chunks, 4).orderBy("rank").collect():
        got[r.request_id].append((r.key, r.score))
    assert got == sparse
    got = {r[0]: [] for r in asked}
    for r in keyword.bm25_topk(wanted, *index(chunks), chunks, 4).orderBy("rank").collect():
        got[r.request_id].append((r.key, round(r.score, 6)))
    assert got == ranked_by_bm25
    found = wanted.join(access.in_scope_counts(spark.createDataFrame(rows, CHUNKS), wanted), "scope_no").collect()
    assert {r.request_id: (r.in_scope, r.readable) for r in found} == {k: v for k, v in counts.items() if v[0]}
    grants = keyword.rights_grants(wanted, keyword.label_table(chunks)).count()
    later = wanted.withColumn("as_of", F.expr("as_of + make_interval(0, 0, 0, request_no % 7)"))
    assert keyword.rights_grants(later, keyword.label_table(chunks)).count() == grants


def test_the_inverted_file_finds_most_and_all_for_narrow_principals(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8))
    v = np.concatenate([m + 0.2 * rng.normal(size=(60, 8)) for m in middles])
    q = np.concatenate([m + 0.2 * rng.normal(size=(3, 8)) for m in middles])
    rows = [("t", f"d{i:03d}", 1, 0, "", "x", 0, 1, 2 if i % 97 else 0, [], [], [], None, None) for i in range(len(v))]
    chunks = written(spark, keyword.number_chunks(spark.createDataFrame(rows, CHUNKS)))
    stored = chunks.join(spark.createDataFrame([(f"d{i:03d}", [float(x) for x in v[i]]) for i in range(len(v))], "key string, vector array<float>"), "key").withColumn("profile_id", F.lit("p"))
    people = [(f"r{i:03d}", "x", "t", None, [], 2 if i % 3 else 0, None, None) for i in range(len(q))]
    asked = written(spark, keyword.number_requests(spark.createDataFrame(people, REQUESTS))).withColumn("subject", F.lit("s"))
    asked = asked.join(spark.createDataFrame([(f"r{i:03d}", [float(x) for x in q[i]]) for i in range(len(q))], "request_id string, vector array<float>"), "request_id").withColumn("profile_id", F.lit("p"))
    quantiser = dense.fit_quantiser(stored, "chunk_no", 24, rounds=6)
    exact = written(spark, dense.exact_topk(asked, stored, 5))
    near = written(spark, dense.near_topk(asked, stored, quantiser, 4, 5))
    report = {r.subject: r for r in dense.ann_recall(exact, near, asked, 5, asked).collect()}
    assert report["all"].recall >= 0.9 and report["all"].fewer_results == 0 and report["all"].refusal is None
    late = dense.near_topk(asked, stored, quantiser, 4, 5, filter_first=False)
    assert {r.subject: r for r in dense.ann_recall(exact, late, asked, 5, asked).collect()}["all"].fewer_results >= 12  # the narrow ones
    refused = dense.ann_recall(exact, near, asked, 5, asked.where("request_id != 'r000'")).collect()
    assert [(r.searches, r.recall, r.refusal) for r in refused] == [(1, None, "the runs sent different searches")]
    whole = written(spark, dense.near_topk(asked, stored, quantiser, 24, 5))
    assert ranked(whole) == ranked(exact)


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 8)).round(3)


def exact_inputs(spark, n_chunks=40, n_requests=7):
    v, q = vectors(spark, n_chunks, 1), vectors(spark, n_requests, 2)
    rows = [("t", f"d{i:03d}", 1, 0, "", "x", 0, 1, i % 2, [], [], [], None, None) for i in range(n_chunks)]
    chunks = written(spark, keyword.number_chunks(spark.createDataFrame(rows, CHUNKS)))
    stored = spark.createDataFrame([(f"d{i:03d}", [float(x) for x in v[i]]) for i in range(n_chunks)], "key string, vector array<float>")
    asked = requests(spark, *["x"] * n_requests).join(
        spark.createDataFrame([(f"r{i}", [float(x) for x in q[i]]) for i in range(n_requests)], "request_id string, vector array<float>"), "request_id"
    )
    profile = F.lit("p")
    expected = {}
    for i in range(n_requests):
        a = q[i].astype(np.float32).astype(float)
        scores = sorted(
            (-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 9), f"d{j:03d}")
            for j, b in enumerate(v.astype(np.float32).astype(float)) if j % 2 == 0
        )[:5]
        expected[f"r{i}"] = [key for _, key in scores]
    return asked.withColumn("profile_id", profile), chunks.join(stored, "key").withColumn("profile_id", profile), expected


def ranked(df):
    out = {}
    for r in df.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.key)
    return out


def test_exact_search_equals_brute_force(spark):
    asked, stored, expected = exact_inputs(spark)
    assert ranked(dense.exact_topk(asked, stored, 5)) == expected


def test_request_blocks_give_the_same(spark, monkeypatch):
    asked, stored, expected = exact_inputs(spark)
    monkeypatch.setattr(blocks, "BLOCK_REQUESTS", 3)
    monkeypatch.setattr(dense, "VECTOR_ROWS", 7)
    assert ranked(dense.exact_topk(asked, stored, 5)) == expected


def test_the_best_of_a_task_keep_no_batch_alive():
    held = pa.total_allocated_bytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(100_000)), pa.array(["x" * 1000] * 1000 + [None] * 99_000)], names=["request_no", "payload"])
    best = blocks.Best(2, batch.column("request_no").to_numpy(zero_copy_only=False))
    del batch
    assert pa.total_allocated_bytes() <= held
    best.trim()  # nothing was added yet
    best.add(np.array([5]), np.array([7, 8, 9]), np.array([[1.0, 3.0, 2.0]]))
    best.trim()
    assert [b.to_pydict() for b in best.result()] == [{"request_no": [5, 5], "chunk_no": [8, 9], "score": [3.0, 2.0]}]


def test_other_profiles_never_meet(spark):
    asked, stored, _ = exact_inputs(spark)
    other = asked.withColumn("profile_id", F.lit("q"))
    assert dense.exact_topk(other, stored, 5).count() == 0
    assert dense.profile_guard(other, stored).count() == 7


def test_fusion_and_greedy_overlap(spark):
    shape = "request_id string, tenant_id string, key string, version_no int, ordinal int, char_start int, char_end int, rank int, score double"
    sparse = spark.createDataFrame([("r", "t", "a", 1, 0, 0, 10, 1, 1.0), ("r", "t", "a", 1, 1, 8, 20, 2, 0.5)], shape)
    vector = spark.createDataFrame([("r", "t", "a", 1, 1, 8, 20, 1, 0.9), ("r", "t", "a", 1, 2, 18, 30, 2, 0.8), ("r", "t", "b", 1, 0, 0, 5, 3, 0.7)], shape)
    fused = fusion.rrf_fuse(sparse, vector).orderBy("fused_rank").collect()
    assert [(r.key, r.ordinal) for r in fused] == [("a", 1), ("a", 0), ("a", 2), ("b", 0)]
    assert abs(fused[0].score - (1 / 62 + 1 / 61)) < 1e-9
    # chunk 1 overlaps kept chunk 0 and is dropped; chunk 2 overlaps only the dropped one and stays
    ordered = spark.createDataFrame([("r", "t", "a", 1, 0, 0, 10, 1, 1.0), ("r", "t", "a", 1, 1, 8, 20, 2, 1.0), ("r", "t", "a", 1, 2, 18, 30, 3, 1.0), ("r", "t", "b", 1, 0, 0, 5, 4, 1.0)], shape)
    kept = fusion.dedupe_topk(ordered, 2, ["request_id"]).orderBy("rank").collect()
    assert [(r.key, r.ordinal, r.rank) for r in kept] == [("a", 0, 1), ("a", 2, 2)]


def test_plan_hashes_are_the_published_ones(spark):
    def hash_of(context):
        plan = fusion.plan_json(F.lit("hybrid-rrf"), F.lit(10), sparse_context=context)
        return spark.range(1).select(fusion.plan_hash(plan).alias("h"), plan.alias("p")).first()

    assert hash_of(False).p == '{"strategy":"hybrid-rrf","k":10,"candidates":50,"rrfK":60,"dedupeOverlaps":true}'
    assert hash_of(False).h == "bd71e8ef3c45267b"
    assert hash_of(True).h == "2598002ea9c41e8d"
    dense_plan = spark.range(1).select(fusion.plan_json(F.lit("dense-only"), F.lit(80)).alias("p")).first().p
    assert '"candidates":80,"rrfK":null' in dense_plan and "Context" not in dense_plan


def test_query_is_cut_beside_the_longest_passage(spark):
    asked = spark.createDataFrame([("r", "a b c d e")], "request_id string, query string")
    passages = spark.createDataFrame([("r", 5), ("r", 4)], "request_id string, word_count int")
    row = fusion.fit_query(asked, passages, limit=11).first()
    assert (row.fitted, row.truncated, row.refused) == ("a b c", True, False)
    assert fusion.fit_query(asked, passages, limit=8).first().refused


def test_vector_problems(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "id int, vector array<float>")
    assert {(r.id, r.problem) for r in dense.vector_problems(rows, 2).collect()} == {(2, "wrong length"), (3, "all zero"), (4, "not finite")}


def test_principal_columns_cover_the_rule():
    assert PRINCIPAL == ["tenant_id", "department", "projects", "clearance_rank"]


def test_model_hooks_load_once_per_task_and_keep_rows_together(spark):
    from permlens.functions import models

    def load_embed():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(150)], "id int, content string")
    got = {r.id: list(r.vector) for r in models.embed_texts(rows, "content", load_embed).collect()}
    assert got == {i: [float(i), 1.0] for i in range(150)}

    def load_score():
        return lambda queries, passages: [len(q) + len(p) for q, p in zip(queries, passages, strict=True)]

    pairs = rows.withColumn("query", F.lit("ab"))
    assert {r.id: r.rerank_score for r in models.score_pairs(pairs, ["id"], load_score).collect()} == {i: float(i + 2) for i in range(150)}


def test_terms_are_counted_after_chunks_are_parted(spark):
    rows = [("t", f"d{i}", 1, 0, "", text, 0, len(text), 0, [], [], [], None, None) for i, text in enumerate(TEXTS)]
    numbered = keyword.number_chunks(spark.createDataFrame(rows, CHUNKS))
    after, _, before = numbered._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")
    assert "n_terms" in after and before and "n_terms" not in before  # the search for the parts' bounds runs what stands before
    assert [r["n_terms"] for r in written(spark, numbered).orderBy("chunk_no").collect()] == [len(t.split()) for t in TEXTS]


def test_wide_rows_in_small_files_are_not_broadcast(spark):
    """Blocks of hashed vectors take a few kilobytes as Parquet and megabytes as rows: beyond the counted bound no plan may broadcast them."""
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = written(spark, spark.range(40).select(F.lit("t").alias("tenant_id"), F.array_repeat(F.lit(0.0), 100_000).alias("vector")))
    many = written(spark, spark.range(50).select(F.lit("t").alias("tenant_id"), "id"))
    met = spread.spread_join(few, many, ["tenant_id"], ["id"], max_rows=32)
    assert "BroadcastExchange" not in nodes(met) and "SortMergeJoin" in nodes(met)
    texts = written(spark, spark.createDataFrame([("r0", "gate launch"), ("r1", ""), ("r2", "gate")], "request_id string, query string"))
    asked = dense.with_vectors(texts, F.col("query"), ["request_id"])
    assert "BroadcastExchange" not in nodes(asked)
    assert {r.request_id: sum(r.vector) for r in asked.collect()} == {"r0": 2.0, "r2": 1.0}


def cell_of(rows, vectors, queries, labels, granted, windows, times):
    """One block of stored vectors before one block of requests, all of one right."""
    ints = lambda values: np.asarray(values, "<i8").tobytes()
    requests = [{"request_no": i, "rights_no": 7, "as_of": t, "vector": [float(x) for x in q]} for i, (q, t) in enumerate(zip(queries, times))]
    kind = pa.list_(pa.struct([("request_no", pa.int64()), ("rights_no", pa.int64()), ("as_of", pa.int64()), ("vector", pa.list_(pa.float32()))]))
    columns = {
        "rows": pa.array([ints(rows)]), "labels": pa.array([ints(labels)]), "opens": pa.array([ints([w[0] for w in windows])]), "closes": pa.array([ints([w[1] for w in windows])]),
        "vectors": pa.array([np.asarray(vectors, "<f4").tobytes()]), "requests": pa.array([requests], kind), "rights": pa.array([[{"rights_no": 7, "granted": granted}]]),
    }
    return blocks.Cell(pa.RecordBatch.from_pydict(columns), 0)


def test_only_pairs_that_can_be_among_the_best_are_scored():
    """After the first block few pairs are computed, and the best are those of brute force: equal scores, rows out of sight and vectors of no or
    no finite length included."""
    rng = np.random.default_rng(3)
    queries, n = rng.integers(-2, 3, (12, 6)).astype(np.float32), 5
    queries[0] = 0
    best, scored, everything = blocks.Best(n, np.arange(12)), [], []
    for k in range(8):
        vectors = rng.integers(-2, 3, (300, 6)).astype(np.float32)
        vectors[7], vectors[8, 0], vectors[9, 1] = 0, np.inf, np.nan
        labels, opens = rng.integers(0, 3, 300), rng.integers(0, 20, 300)
        times = [None if i % 3 else 10 for i in range(12)]
        cell = cell_of(np.arange(300) * 2 + 600 * (7 - k), vectors, queries, labels, [0, 2], [(o, o + 8) for o in opens], times)
        fresh, count = not best.size, 0
        for of, at, scores in dense._cosine(cell, best):
            seen = cell.sees(of, at)
            best.add(of[seen], cell.rows[at[seen]], scores[seen])
            count += len(of)
        if fresh:
            best.trim()
        scored.append(count)
        for i in range(12):
            for j in range(300):
                a, b = queries[i].astype(float), vectors[j].astype(float)
                if labels[j] != 1 and (times[i] is None or opens[j] <= 10 < opens[j] + 8) and a.any() and b.any() and np.isfinite(b).all():
                    everything.append((i, -(round(float(a @ b / np.sqrt((a * a).sum() * (b * b).sum())), 9) + 0.0), int(cell.rows[j])))
    best.trim()
    got = [(r, -s, c) for batch in best.result() for r, s, c in zip(*(batch.column(x).to_pylist() for x in ("request_no", "score", "chunk_no")))]
    wanted = [x for i in range(12) for x in sorted(e for e in everything if e[0] == i)[:n]]
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in wanted]
    assert max(scored[2:]) < 12 * 300 / 4


def test_a_request_of_an_inverted_file_is_one_row_whatever_it_probes(spark, monkeypatch):
    asked, stored, expected = exact_inputs(spark)
    blocks_of, write = [], dense.written

    def noted(df, name):
        out = write(df, name)
        if name == "asked-blocks":
            blocks_of.append(out.agg(F.sum(F.size("requests"))).first()[0] or 0)
        return out

    monkeypatch.setattr(dense, "written", noted)
    quantiser = dense.fit_quantiser(stored, "chunk_no", 10)
    assert ranked(dense.near_topk(asked, stored, quantiser, 10, 5)) == expected
    dense.near_topk(asked, stored, quantiser, 9, 5)
    assert blocks_of[0] == 7 and max(blocks_of) <= 7


def test_postings_are_made_within_chunks_and_shuffled_once(spark):
    chunks = corpus(spark)
    made = keyword.postings(chunks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan
    wanted = []
    for r in chunks.collect():
        terms = [t.replace("stones", "stone") for t in r["content"].split()]
        for term in set(terms):
            at = [i for i, t in enumerate(terms) if t == term]
            wanted.append((term, r["chunk_no"], r["label_no"], r["tenant_id"], len(terms), len(at), at))
    got = [(r["term"], r["chunk_no"], r["label_no"], r["tenant_id"], r["n_terms"], r["tf"], list(r["positions"])) for r in made.collect()]
    assert got == sorted(wanted)
    assert keyword.postings(chunks.limit(0)).collect() == []
