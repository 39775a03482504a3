"""Load runs: request summaries, stage timings, growth of the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.operators import metrics


def compare_latency(timed: DataFrame) -> DataFrame:
    """p50 and p95 before and after per strategy, compared only when both runs were served by the same processor."""
    b = timed.where("run = 'before'").select("strategy", F.col("p50_ms").alias("before_p50_ms"), F.col("p95_ms").alias("before_p95_ms"), F.col("cpu").alias("before_cpu"))
    a = timed.where("run = 'after'").select("strategy", F.col("p50_ms").alias("after_p50"), F.col("p95_ms").alias("after_p95"), F.col("cpu").alias("after_cpu"))
    same = F.col("before_cpu") == F.col("after_cpu")
    return b.join(a, "strategy").select(
        "strategy", "before_p50_ms", "before_p95_ms", F.when(same, F.col("after_p50")).alias("after_p50_ms"), F.when(same, F.col("after_p95")).alias("after_p95_ms"), same.alias("compared")
    )


def status_name():
    return F.when(F.col("status") == 0, "error").when(F.col("code").isNotNull(), F.concat_ws(" ", F.col("status").cast("string"), "code")).otherwise(F.col("status").cast("string"))


def histogram(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """value:count pairs per group as one sorted text, from counted values."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(value, "_n")))
    return counted.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x[value], x["_n"].cast("string"))), ",").alias(out))


def load_summary(requests: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Requests, status and degraded-reason histograms, violations and latency per strategy."""
    counts = requests.groupBy("strategy").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.size("violations")).alias("violations"))
    statuses = histogram(requests.withColumn("name", status_name()), ["strategy"], "name", "statuses")
    reasons = histogram(requests.select("strategy", F.explode("degraded").alias("reason")), ["strategy"], "reason", "degraded")
    return counts.join(statuses, "strategy").join(reasons, "strategy", "left").join(percentiles, "strategy", "left").na.fill("", ["degraded"])


def load_totals(requests: DataFrame) -> DataFrame:
    """Failures, degraded answers, violations, throughput and repeated trace ids of a whole run. Traces are counted by grouping, so no
    task holds their set."""
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    totals = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") != 200).alias("failed"),
        F.count_if(F.size("degraded") > 0).alias("degraded"),
        F.sum(F.size("violations")).alias("violations"),
        F.try_divide(F.count(F.lit(1)), seconds).alias("requests_per_second"),
    )
    per_trace = requests.where("trace_id is not null").groupBy("trace_id").agg((F.count(F.lit(1)) - 1).alias("again"))
    repeated = per_trace.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("repeated_trace_ids"))
    return totals.withColumn("_", F.lit(1)).join(repeated.withColumn("_", F.lit(1)), "_").drop("_")


def expected_requests(numbered_cases: DataFrame, cases: int, strategies: list[str], requests: int) -> DataFrame:
    """The cases times the strategies, cycled to a number of requests; cases are numbered from 1."""
    total = cases * len(strategies)
    each = numbered_cases.select("case_id", "n", F.posexplode(F.array(*[F.lit(s) for s in strategies])).alias("s", "strategy"))
    place = (F.col("n") - 1) * len(strategies) + F.col("s")
    placed = each.withColumn("place", place).where(F.col("place") < requests)
    return placed.select("case_id", "strategy", F.explode(F.sequence(F.col("place"), F.lit(requests - 1).cast("bigint"), F.lit(total).cast("bigint"))).alias("request_no"))


def as_each_principal(cases: DataFrame, subjects: list[str]) -> DataFrame:
    """Every case asked by each of a few principals."""
    return cases.withColumn("principal", F.explode(F.array(*[F.lit(s) for s in subjects])))


def union_visibility(labelled: DataFrame, generated: DataFrame) -> DataFrame:
    """Labelled visibility with that of generated documents added; generated documents have one version."""
    a = labelled.select("principal", "document").withColumn("generated", F.lit(False))
    b = generated.select("principal", "document").withColumn("generated", F.lit(True))
    return a.unionByName(b).groupBy("principal", "document").agg(F.bool_or("generated").alias("generated"))


def scale_summary(runs: DataFrame, audit: DataFrame, stages: DataFrame) -> DataFrame:
    """Latency, stage timings and audit growth per corpus size, workers and strategy; growth is unknown when a reading is missing."""
    size = ["size", "workers"]
    side = lambda name, value: F.max(F.when(F.col("label") == name, F.col(value)))
    growth = audit.groupBy(*size).agg(
        (side("after", "bytes") - side("before", "bytes")).alias("grown_bytes"), (side("after", "rows") - side("before", "rows")).alias("grown_rows")
    )
    totals = runs.groupBy(*size).agg(F.sum("requests").alias("total"))
    return (
        runs.join(totals, size).join(growth, size, "left").join(stages, [*size, "strategy"], "left")
        .withColumn("audit_rows_per_1000", F.round(F.col("grown_rows") * 1000 / F.col("total")))
        .withColumn("audit_kib_per_1000", F.round(F.col("grown_bytes") * 1000 / F.col("total") / 1024))
        .drop("total", "grown_bytes", "grown_rows")
    )


def stage_percentiles(executions: DataFrame, stages: list[str]) -> DataFrame:
    """Interpolated percentiles of the stage latencies of recorded executions per strategy."""
    long = executions.unpivot(["strategy"], stages, "stage", "ms")
    shares = {"p50": 0.5, "p95": 0.95}
    found = metrics.interpolated(long, ["strategy", "stage"], "ms", shares)
    columns = [F.max(F.when(F.col("stage") == s, F.col(p))).alias(f"{s}_{p}") for s in stages for p in shares]
    wide = found.groupBy("strategy").agg(*columns)
    return executions.groupBy("strategy").agg(F.count(F.lit(1)).alias("executions")).join(wide, "strategy", "left")
