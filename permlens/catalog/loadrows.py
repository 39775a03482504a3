"""Request records and audit rows derived from the events table, as Spark columns and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog.sql import h
from permlens.functions.hashing import draw
from permlens.operators.fusion import STRATEGIES
from permlens.plans.corpus import Corpus

KEY = "event_id"


def requests(c: Corpus) -> DataFrame:
    """One recorded request per event."""
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (draw("strat", KEY) % 4).cast("int") + 1)
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    reason = F.element_at(F.array(F.lit("dense_unavailable"), F.lit("rerank_unavailable")), (draw("why", KEY) % 2).cast("int") + 1)
    none = F.expr("cast(array() as array<string>)")
    result = F.struct(
        F.concat(F.lit("doc-"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("document"), F.lit(1).alias("version"), F.lit(0).alias("start"),
        F.round(F.col("value") / 1000, 6).alias("score"),
    )
    return c.given("events").select(
        "event_id",
        F.concat(F.lit("case-"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("case"),
        F.concat(F.lit("user-"), (F.col("user_id") % 7).cast("string")).alias("principal"),
        strategy.alias("strategy"),
        status.alias("status"),
        F.when((draw("deg", KEY) % 10 == 0) & (F.col("event_type") != "error"), F.array(reason)).otherwise(none).alias("degraded"),
        F.when(draw("viol", KEY) % 100 == 0, F.array(F.concat(F.lit("doc-"), KEY))).otherwise(none).alias("violations"),
        F.when(F.col("event_type") != "error", F.md5(F.floor(F.col("event_id") / 3).cast("string"))).alias("trace_id"),
        F.round("value", 1).alias("latency_ms"),
        F.when(F.col("event_type") != "error", F.array(result)).alias("results"),
        F.when((F.col("event_type") == "error") & (draw("code", KEY) % 2 == 0), "BUSY").alias("code"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


REQUEST_SQL = f"""
    select event_id, 'case-' || lpad(user_id::VARCHAR, 7, '0') as case_id, 'user-' || (user_id % 7) as principal,
        (['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank'])[({h('strat', 'event_id')} % 4 + 1)::INT] as strategy,
        case when event_type = 'error' then 503 else 200 end as status,
        case when {h('deg', 'event_id')} % 10 = 0 and event_type <> 'error' then (['dense_unavailable', 'rerank_unavailable'])[({h('why', 'event_id')} % 2 + 1)::INT] end as reason,
        case when {h('viol', 'event_id')} % 100 = 0 then 1 else 0 end as violations, case when event_type <> 'error' then md5((event_id // 3)::VARCHAR) end as trace_id,
        round(value, 1) as latency_ms, case when event_type = 'error' and {h('code', 'event_id')} % 2 = 0 then 'BUSY' end as code, ts, user_id, value, event_type
    from events"""

ACTIONS = {"click": "retrieval.search", "view": "document.read", "purchase": "query.answer", "signup": "ingestion.submit", "error": "retrieval.search"}


def audit(c: Corpus) -> DataFrame:
    """One audit row per event."""
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("event_type"))
    return c.given("events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.when(F.col("user_id") % 10 == 0, "external").otherwise("northstar").alias("tenant_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("principal_id"),
        action.alias("action"),
        F.md5(F.floor(F.col("event_id") / 3).cast("string")).alias("trace_id"),
        "props",
        "value",
        "event_type",
    )


AUDIT_SQL = f"""
    select event_id, ts as occurred_at, case when user_id % 10 = 0 then 'external' else 'northstar' end as tenant_id, 'user-' || user_id as principal_id,
        case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items())} end as action, md5((event_id // 3)::VARCHAR) as trace_id, props, value, event_type from events"""
