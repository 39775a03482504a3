"""Execution records, audit events, export, retention and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.functions.labels import POLICY_VERSION
from permlens.operators import fusion
from permlens.operators.numbering import number_rows

# What an exported span may carry, how old an export's rows must be, how many rows a purge takes at once.
ALLOWED_ATTRIBUTES = (
    "pipeline.config_hash", "policy.version", "retrieval.strategy", "retrieval.k", "retrieval.candidates", "retrieval.results", "model.name",
    "model.queue_ms", "model.compute_ms", "degraded", "error.type", "answer.status", "answer.statements", "answer.rejected_statements",
    "context.evidence", "prompt.version", "method", "uri", "status", "outcome", "exception", "client.name",
)
EXPORT_MINIMUM_AGE = "1 hour"
PURGE_BATCH = 1000
# Error codes of failed work by kind of cause, and whether trying again can help.
FAILURES = {
    "model_down": ("MODEL_SERVICE_UNAVAILABLE", True),
    "database_transient": ("DATABASE_UNAVAILABLE", True),
    "model_rejected": ("MODEL_SERVICE_REJECTED", False),
    "model_invalid": ("MODEL_RESPONSE_INVALID", False),
    "text_too_long": ("MODEL_RESPONSE_INVALID", False),
    "profile_mismatch": ("INDEX_PROFILE_MISMATCH", False),
}
OTHER_FAILURE = ("INTERNAL_ERROR", False)


NO_TEXTS = "cast(array() as array<string>)"


def execution_records(decided: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """One record per search, also of searches that found nothing: plan, policy, models, status, reasons, counts, documents in order of first
    rank, time per stage. Nothing of the query's or a chunk's text. `decided` is (request_id, tenant_id, subject, trace_id, strategy, status,
    reasons, embedding_model, index_profile_id, reranker_model, query_truncated, sparse_ms, dense_ms, rerank_ms, as_of, region); a
    stage that did not run has no time and no model."""
    named = results.groupBy("request_id", "strategy", F.concat_ws("@v", "key", "version_no").alias("document")).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    found = named.groupBy("request_id", "strategy").agg(
        F.sum("n").alias("result_count"), F.transform(F.sort_array(F.collect_list(F.struct("first", "document"))), lambda x: x["document"]).alias("documents")
    )
    plan = fusion.plan_json(F.col("strategy"), F.lit(k))
    dense = (F.col("strategy") != "sparse-only") & ~F.array_contains("reasons", "dense_unavailable") & (F.col("status") != "failed")
    sparse = F.col("strategy") != "dense-only"
    reranked = (F.col("strategy") == "hybrid-rrf-rerank") & ~F.array_contains("reasons", "rerank_unavailable")
    stage = lambda ran, name: F.when(ran, F.col(name)).alias(name)
    total = F.coalesce(F.when(sparse, F.col("sparse_ms")), F.lit(0)) + F.coalesce(F.when(dense, F.col("dense_ms")), F.lit(0)) + F.coalesce(F.when(reranked, F.col("rerank_ms")), F.lit(0))
    return decided.join(found, ["request_id", "strategy"], "left").select(
        "request_id", "tenant_id", F.col("subject").alias("principal_id"), "trace_id", "strategy", F.lit(k).alias("k"), fusion.plan_hash(plan).alias("plan_hash"), plan.alias("plan"),
        F.lit(POLICY_VERSION).alias("policy_version"), stage(dense, "embedding_model"), stage(dense, "index_profile_id"), stage(reranked, "reranker_model"),
        F.when(reranked, F.col("query_truncated")).alias("query_truncated"), "status", "reasons", F.coalesce("result_count", F.lit(0)).alias("result_count"),
        F.coalesce("documents", F.expr(NO_TEXTS)).alias("documents"), total.alias("total_ms"), stage(sparse, "sparse_ms"), stage(dense, "dense_ms"), stage(reranked, "rerank_ms"), "as_of", "region",
    )


def _events(rows: DataFrame, action: Column | str, resource_type: str, resource: Column, attributes: Column | None = None, decision: Column | str = "allow", policy: bool = True) -> DataFrame:
    """(tenant_id, principal_id, trace_id) rows as audit events; attributes hold identifiers, counts and versions only, and missing ones stay
    as nulls."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    empty = F.lit("{}") if attributes is None else F.to_json(attributes, {"ignoreNullFields": "false"})
    return rows.select(
        resource.alias("resource_id"), "tenant_id", "principal_id", as_column(action).alias("action"), F.lit(resource_type).alias("resource_type"), as_column(decision).alias("decision"),
        F.lit(POLICY_VERSION if policy else None).cast("string").alias("policy_version"), "trace_id", empty.alias("attributes"),
    )


def search_events(records: DataFrame) -> DataFrame:
    attributes = F.struct(
        "strategy", "k", F.col("plan_hash").alias("planHash"), F.col("result_count").alias("resultCount"), "documents", F.col("reasons").alias("degraded"),
        F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("asOf"), "region",
    )
    return _events(records, "retrieval.search", "query_execution", F.col("request_id"), attributes)


def read_events(decisions: DataFrame) -> DataFrame:
    """Reads of one document: who asked for what and the decision. An unknown reader is denied and recorded without a tenant."""
    return _events(decisions.withColumn("principal_id", F.col("subject")), "document.read", "document", F.col("key"), decision=F.col("decision"))


def listing_events(pages: DataFrame) -> DataFrame:
    """One event per page of a listing of all a principal may read: `pages` is (tenant_id, principal_id, trace_id, chunk_count, scoped)."""
    return _events(pages, "retrieval.list_chunks", "chunk_listing", F.col("tenant_id"), F.struct(F.col("chunk_count").alias("chunkCount"), "scoped"))


def ingestion_events(submissions: DataFrame) -> DataFrame:
    """One event per submitted job of a tenant, with its documents in order (a job has a bounded number of them): submissions are
    (tenant_id, principal_id, trace_id, job_id, ordinal, key)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "key"))), lambda x: x["key"])
    jobs = submissions.groupBy("tenant_id", "principal_id", "trace_id", "job_id").agg(listed.alias("documents"))
    return _events(jobs, "ingestion.submit", "ingestion_job", F.col("job_id"), F.struct("documents"), policy=False)


def change_events(changes: DataFrame) -> DataFrame:
    """Status changes and deletions of documents, with the status after the change: changes are (tenant_id, principal_id, trace_id, key, status)."""
    action = F.when(F.col("status") == "deleted", "document.delete").otherwise("document.status")
    return _events(changes, action, "document", F.col("key"), F.struct("status"), policy=False)


def answer_events(answers: DataFrame) -> DataFrame:
    """Outcomes of answered questions, linked to the execution of their retrieval: counts and versions, neither question nor answer."""
    attributes = F.struct(
        "status", F.col("evidence_count").alias("evidenceCount"), F.col("statement_count").alias("statementCount"), F.col("rejected_statements").alias("rejectedStatements"),
        F.col("chat_model").alias("chatModel"), F.col("prompt_version").alias("promptVersion"),
    )
    return _events(answers, "query.answer", "query_execution", F.col("execution_id"), attributes)


def purge_events(batches: DataFrame) -> DataFrame:
    """One event per purged batch of (table_name, cut_off, removed): a system action of no tenant."""
    system = batches.select("*", F.lit("").alias("tenant_id"), F.lit("system:audit-cleanup").alias("principal_id"), F.lit("").alias("trace_id"))
    attributes = F.struct(F.col("table_name").alias("table"), F.date_format("cut_off", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("cutOff"), F.col("removed").alias("rows"))
    return _events(system, "audit.purge", "audit_table", F.col("table_name"), attributes, policy=False)


def owner_lookup(lookups: DataFrame, executions: DataFrame) -> DataFrame:
    """An execution is found only by its own tenant and principal; anyone else's looks missing."""
    owner = ["execution_id", "tenant_id", "principal_id"]
    own = executions.select(*owner).withColumn("found", F.lit(True))
    return lookups.join(own, owner, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def job_lookup(lookups: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job is found by anyone of its own tenant; another tenant's looks missing. jobs are (job_id, tenant_id, state)."""
    same = ["job_id", "tenant_id"]
    return lookups.join(jobs.select(*same, "state"), same, "left")


def export_through(rows: DataFrame, through: Column, now: Column) -> DataFrame:
    """Rows an export takes: everything before `through`, which must lie far enough back that no row can still arrive before it."""
    allowed = through <= now - F.expr(f"interval {EXPORT_MINIMUM_AGE}")
    return rows.where(F.when(allowed, F.col("occurred_at") < through).otherwise(F.raise_error(F.lit("the export must end at least one hour ago")).cast("boolean")))


def retention_cutoffs(tables: DataFrame, exports: DataFrame, now: Column) -> DataFrame:
    """Before when each table may be purged: its retention, but never past its latest export where one is required. Unknown means keep.
    `tables` is (table_name, retention_days, needs_export)."""
    latest = exports.groupBy("table_name").agg(F.max("through").alias("exported"))
    kept = now - F.make_dt_interval(F.col("retention_days"))
    cut = F.when(F.col("retention_days").isNull() | (F.col("needs_export") & F.col("exported").isNull()), F.lit(None).cast("timestamp")).when(
        F.col("needs_export"), F.least(kept, F.col("exported"))
    )
    return tables.join(F.broadcast(latest), "table_name", "left").select("table_name", F.when(F.col("retention_days") < 1, F.lit(None)).otherwise(F.coalesce(cut, F.when(~F.col("needs_export"), kept))).alias("cut_off"))


def purge_batches(rows: DataFrame, cut_offs: DataFrame, order: list[str], batch: int = PURGE_BATCH) -> DataFrame:
    """The rows of each table before its cut-off, oldest first, in batches; a table without a cut-off keeps all. rows are (table_name,
    occurred_at, order); cut_offs is `retention_cutoffs`."""
    known = F.broadcast(cut_offs.where("cut_off is not null"))  # one row per table
    due = rows.join(known, "table_name").where(F.col("occurred_at") < F.col("cut_off"))
    numbered = number_rows(due, ["table_name"], order, "nth")
    return numbered.groupBy("table_name", "cut_off", F.ceil(F.col("nth") / batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("removed"), F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest")
    )


def remaining(rows: DataFrame, cut_off: Column) -> DataFrame:
    return rows.where(cut_off.isNull() | (F.col("occurred_at") >= cut_off))


def storage_gauges(rows: DataFrame, now: Column) -> DataFrame:
    """Rows and the age of the oldest, zero when empty."""
    age = F.unix_seconds(now) - F.unix_seconds(F.min("occurred_at"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(age, F.lit(0)).alias("oldest_seconds"))


def redact(spans: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Only allowed attribute keys leave; events and status text do not."""
    kept = F.map_filter(attributes, lambda k, _: k.isin(*ALLOWED_ATTRIBUTES))
    return spans.withColumn(attributes, kept).drop("events", "status_text")


def trace_differences(audits: DataFrame, executions: DataFrame) -> DataFrame:
    """Audit events and executions per trace, with the traces that only one side has."""
    a = audits.groupBy("trace_id").agg(F.count(F.lit(1)).alias("audits"))
    e = executions.groupBy("trace_id").agg(F.count(F.lit(1)).alias("executions"))
    both = a.join(e, "trace_id", "full").na.fill(0, ["audits", "executions"])
    side = F.when(F.col("audits") == 0, "no audit event").when(F.col("executions") == 0, "no execution").otherwise("matched")
    return both.withColumn("side", side)


def failure_histogram(failures: DataFrame) -> DataFrame:
    """Failed work by error code, and whether it is worth trying again. `failures` has a `cause`."""
    code, again = F.lit(OTHER_FAILURE[0]), F.lit(OTHER_FAILURE[1])
    for cause, (name, retry) in FAILURES.items():
        code = F.when(F.col("cause") == cause, name).otherwise(code)
        again = F.when(F.col("cause") == cause, F.lit(retry)).otherwise(again)
    return failures.groupBy(code.alias("code"), again.alias("retryable")).agg(F.count(F.lit(1)).alias("failures"))
