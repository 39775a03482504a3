"""The four retrieval strategies over one pair of ranked channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.operators import fusion
from permlens.operators.access import CHUNK
from permlens.operators.keyword import PLACE
from permlens.session import broadcast_if_small, written


def pool_pairs(pool: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The query and passage text of every pooled candidate, for a scorer."""
    asked = broadcast_if_small(requests.select("request_id", "query"), max_rows=100_000)
    return pool.select("request_id", *CHUNK).join(chunks.select(*CHUNK, "content"), CHUNK).join(asked, "request_id")


def overlap_scores(pool: DataFrame, requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Re-ranking scores of a pool. Passages are read once, by the pool's chunk keys; the score is one native expression."""
    texts = pool_pairs(pool, requests, chunks)
    score = F.round(fusion.word_overlap(F.col("query"), F.col("content")), 9)
    return texts.select("request_id", *CHUNK, score.alias("rerank_score"))


def all_strategies(requests: DataFrame, chunks: DataFrame, sparse: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Top k of every strategy for every request as one table."""
    group = ["request_id"]
    fused = written(fusion.rrf_fuse(sparse, dense), "fused")
    pool = written(fusion.dedupe_topk(fused, max(fusion.RERANK_CANDIDATES, k), group, rank="fused_rank", out="fused_rank"), "pool")
    reranked = fusion.rerank(pool, overlap_scores(pool, requests, chunks)).where(F.col("rank") <= k)
    empty = F.lit(None).cast("double")
    shape = ["request_id", "strategy", "rank", *CHUNK, *PLACE, "score"]

    def branch(df: DataFrame, strategy: str, score: str = "score") -> DataFrame:
        return df.withColumn("strategy", F.lit(strategy)).withColumn("score", F.coalesce(F.col(score), empty)).select(*shape)

    return (
        branch(fusion.dedupe_topk(sparse, k, group), "sparse-only")
        .unionByName(branch(fusion.dedupe_topk(dense, k, group), "dense-only"))
        .unionByName(branch(fusion.dedupe_topk(fused, k, group, rank="fused_rank"), "hybrid-rrf"))
        .unionByName(branch(reranked, "hybrid-rrf-rerank", "rerank_score"))
    )
