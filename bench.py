"""Times the headline queries: python bench.py prints one JSON line. BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import time

from permlens.catalog import registry
from permlens.plans.corpus import Corpus
from permlens.session import build_session

# Tables that several queries share, each built on its own line before the queries that read it are timed.
SHARED = ["candidates", "postings", "posting_blocks", "scoped", "sparse", "dense", "bm25", "results", "records"]
HEADLINE = [
    "a3_authorize_all_principals",
    "a7_list_authorized_chunks",
    "a8_document_read_decision",
    "a13_policy_differential",
    "n10_fit_token_budget",
    "v2_assign_version_numbers",
    "x3_sparse_topk",
    "x4_bm25_topk",
    "d1_dense_exact_topk",
    "d4_dense_sparse_dot_topk",
    "d5_ann_candidates",
    "f1_rrf_fuse",
    "f8_search_all_strategies",
    "e10_case_records",
    "e15_validate_dataset",
    "e18_latency_p50_p95",
    "b1_bootstrap_ci",
    "b6_compare_strategies",
    "l4_load_summary",
    "l3_summarize_answers",
    "l10_stage_percentiles",
    "o6_audit_purge",
    "t1_stream_requests_per_minute",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(cores, "permlens-bench")
    queries = registry.queries()
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    corpus = Corpus(spark, folder)
    for name in SHARED:
        timed(f"build_{name}", lambda name=name: getattr(corpus, name).count())
    requests = corpus.scoped.count()
    for name in HEADLINE:
        timed(name, lambda name=name: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 3)
    rate = {n: round(requests / seconds[b], 1) for n, b in (("x3_sparse_topk", "build_sparse"), ("x4_bm25_topk", "build_bm25"), ("dense", "build_dense"), ("d1_dense_exact_topk", "d1_dense_exact_topk"))}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1],
                "cores": cores, "requests": requests, "requests_per_second": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
