"""Fusing, de-duplicating and re-ranking the channels, and the plan each strategy is recorded with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permlens.functions import text as T
from permlens.operators.access import CHUNK
from permlens.operators.keyword import PLACE

# The four strategies and the constants of their plans.
STRATEGIES = ("sparse-only", "dense-only", "hybrid-rrf", "hybrid-rrf-rerank")
RRF_K = 60
CANDIDATES = 50
RERANK_CANDIDATES = 20
MODEL_LIMIT = 512
PAIR_TOKENS = 3
EMBEDDING_MISSING = "dense_unavailable"
RERANK_MISSING = "rerank_unavailable"

FUSED_ORDER = ["key", "version_no", "char_start"]


def rrf_fuse(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of the union of both channels."""
    keys = ["request_id", *CHUNK, *PLACE]
    s = sparse.select(*keys, F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    d = dense.select(*keys, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    part = lambda rank: F.coalesce(F.lit(1.0) / (RRF_K + F.col(rank)), F.lit(0.0))
    fused = s.join(d, keys, "full").withColumn("score", F.round(part("sparse_rank") + part("dense_rank"), 9))
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), *FUSED_ORDER)))


def dedupe_topk(ranked: DataFrame, k: int, group: list[str], rank: str = "rank", out: str = "rank") -> DataFrame:
    """In rank order, keeps a chunk unless it overlaps one already kept, until k are kept; numbers them from 1. A dropped chunk hides
    nothing, so this is a fold over one request's candidates, whose number the channels bound."""
    carried = [c for c in ranked.columns if c not in (*group, rank)]
    item = F.struct(F.col(rank).alias("place"), *carried)
    fields = ranked.select(item.alias("x")).schema["x"].dataType.simpleString()

    def overlaps(kept: Column, x: Column) -> Column:
        return F.exists(
            kept,
            lambda y: (y["key"] == x["key"]) & (y["version_no"] == x["version_no"]) & (y["char_start"] < x["char_end"]) & (x["char_start"] < y["char_end"]),
        )

    kept = F.aggregate(
        F.sort_array(F.collect_list(item)),
        F.array().cast(f"array<{fields}>"),
        lambda acc, x: F.when((F.size(acc) >= k) | overlaps(acc, x), acc).otherwise(F.concat(acc, F.array(x))),
    )
    rows = ranked.groupBy(*group).agg(kept.alias("kept")).select(*group, F.posexplode("kept").alias("pos", "x"))
    return rows.select(*group, (F.col("pos") + 1).alias(out), *[F.col(f"x.{c}").alias(c) for c in carried])


def word_overlap(query: Column, passage: Column) -> Column:
    """The share of a query's distinct words that a passage has: the deterministic stand-in for a re-ranking model."""
    wanted = F.array_distinct(T.plain_words(query))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, T.plain_words(passage))) / F.size(wanted)
    )


def rerank(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """The scored head of a pool in score order, then the unscored tail as it was; equal scores keep the fused order."""
    scored = pool.join(scores, ["request_id", *CHUNK], "left")
    order = [F.col("rerank_score").isNull(), F.desc("rerank_score"), F.col("fused_rank")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def fit_query(requests: DataFrame, passages: DataFrame, limit: int = MODEL_LIMIT) -> DataFrame:
    """Queries cut to the words that fit beside the longest passage; passages are never cut, and one that leaves no room refuses the query."""
    longest = passages.groupBy("request_id").agg(F.max("word_count").alias("longest"))
    words = F.regexp_extract_all(F.col("query"), F.lit(r"(\S+)"), 1)
    room = F.greatest(F.lit(limit - PAIR_TOKENS) - F.col("longest"), F.lit(0))
    fits = T.word_count(F.col("query")) <= room
    return requests.join(longest, "request_id").select(
        "request_id", "longest", F.when(fits, F.size(words)).otherwise(room).alias("kept_words"),
        F.when(fits, F.col("query")).otherwise(F.array_join(F.slice(words, F.lit(1), room), " ")).alias("fitted"),
        (~fits).alias("truncated"), (~fits & (room < 1)).alias("refused"),
    )


def fall_back(requests: DataFrame, has_vector: Column, has_scores: Column) -> DataFrame:
    """What each strategy does when a model's output is missing: the channel it falls back to, its reasons and its status."""
    strategies = F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))
    rows = requests.withColumn("has_vector", has_vector).withColumn("has_scores", has_scores).withColumn("strategy", strategies)
    dense, hybrid, reranks = F.col("strategy") == "dense-only", F.col("strategy").startswith("hybrid"), F.col("strategy") == "hybrid-rrf-rerank"
    reasons = F.array_compact(
        F.array(
            F.when(hybrid & ~F.col("has_vector"), F.lit(EMBEDDING_MISSING)),
            F.when(reranks & ~F.col("has_scores"), F.lit(RERANK_MISSING)),
        )
    )
    order = (
        F.when(F.col("strategy") == "sparse-only", "sparse")
        .when(dense, F.when(F.col("has_vector"), "dense"))
        .when(reranks & F.col("has_scores"), "rerank")
        .when(F.col("has_vector"), "fused")
        .otherwise("sparse")
    )
    return rows.withColumn("order_by", order).withColumn("reasons", reasons).withColumn(
        "status", F.when(F.col("order_by").isNull(), "failed").when(F.size("reasons") > 0, "degraded").otherwise("ok")
    )


def plan_json(strategy: Column, k: Column, reranker: str = "word-overlap", sparse_context: bool = True, rerank_context: bool = False) -> Column:
    """The canonical text of a retrieval plan. Keys that do not apply to a strategy are left out."""
    fuses, reranks = strategy.startswith("hybrid"), strategy == "hybrid-rrf-rerank"
    optional = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"strategy":"'), strategy, F.lit('","k":'), k.cast("string"),
        F.lit(',"candidates":'), F.greatest(F.lit(CANDIDATES), k).cast("string"),
        F.lit(',"rrfK":'), F.when(fuses, F.lit(str(RRF_K))).otherwise(F.lit("null")), F.lit(',"dedupeOverlaps":true'),
        optional(reranks, F.concat(F.lit(',"rerankCandidates":'), F.greatest(F.lit(RERANK_CANDIDATES), k).cast("string"), F.lit(f',"reranker":"{reranker}"'))),
        optional((strategy != "dense-only") & F.lit(sparse_context), F.lit(',"sparseContext":true')),
        optional(reranks & F.lit(rerank_context), F.lit(',"rerankContext":true')),
        F.lit("}"),
    )


def plan_hash(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 16)
