"""Windowed rates and latencies of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency histogram; the last bucket is open.
BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def requests_per_minute(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests per kind in one-minute windows; a window comes out once, when nothing can still arrive for it."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute"), "event_type")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("minute"), "event_type", "requests")
    )


def bucket_bound(counts: list[Column], total: Column, share: float) -> Column:
    """The upper bound of the bucket that holds a share of all values."""
    bound = F.lit(None).cast("double")
    running = F.lit(0)
    choices = []
    for upper, count in zip(BOUNDS, counts, strict=True):
        running = running + count
        choices.append((running >= total * share, upper))
    for reached, upper in reversed(choices):
        bound = F.when(reached, F.lit(upper)).otherwise(bound)
    return bound


def sliding_latency(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The 95th percentile bucket of latency in one-minute windows every ten seconds, from counts per bucket that add up anywhere."""
    lower = (float("-inf"), *BOUNDS[:-1])
    counts = [F.count_if((F.col("value") > a) & (F.col("value") <= b)).alias(f"b{i}") for i, (a, b) in enumerate(zip(lower, BOUNDS, strict=True))]
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute", "10 seconds")).agg(F.count(F.lit(1)).alias("n"), *counts)
    p95 = bucket_bound([F.col(f"b{i}") for i in range(len(BOUNDS))], F.col("n"), 0.95)
    return grouped.select(F.col("window.start").alias("starts"), "n", p95.alias("p95_le"))


def distinct_traces(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each trace once; repeats within the delay are dropped, and the state of older ones is forgotten."""
    traced = events.select("ts", F.md5(F.floor(F.col("event_id") / 3).cast("string")).alias("trace_id"))
    return traced.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trace_id"]).select("trace_id")


def unaudited_executions(executions: DataFrame, audits: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Every execution with its audit event, if one follows within the time allowed; alert is true where none did."""
    e = executions.withWatermark("executed_at", "1 minute").alias("e")
    a = audits.withWatermark("audited_at", "1 minute").alias("a")
    follows = (
        (F.col("e.execution_id") == F.col("a.audit_id"))
        & (F.col("a.audited_at") >= F.col("e.executed_at"))
        & (F.col("a.audited_at") <= F.col("e.executed_at") + F.expr(f"interval {within}"))
    )
    return e.join(a, follows, "left_outer").select("execution_id", F.col("audit_id").isNull().alias("alert"))
