"""Audit and operations data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.catalog import answers, loadrows, versions
from permlens.catalog.access import PAGE as LISTING_PAGE
from permlens.catalog.retrieval import PLAN_SQL
from permlens.catalog.sources import EXPORT_FILE_BYTES, folder
from permlens.catalog.sql import authorized, h, one_of, sql, words
from permlens.functions.hashing import draw, one_of as drawn
from permlens.operators import access, audit, fusion
from permlens.operators.access import CHUNK
from permlens.plans.corpus import Corpus
from permlens.sources import files
from permlens.session import broadcast_if_small
from permlens.sources.tables import QUERY_PRINCIPALS, UNKNOWN

EVENT = "event_id"
THROUGH = "2024-01-20 00:00:00"


def text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def executions(c: Corpus) -> DataFrame:
    """Every search with what its record needs: models, stage times and truncation as drawn or computed, traces by request."""

    def build() -> DataFrame:
        request = F.col("request_id")
        passages = c.results.where("strategy = 'hybrid-rrf'").join(c.candidates.select(*CHUNK, "word_count"), CHUNK)
        cut = fusion.fit_query(c.scoped, passages).select("request_id", "truncated")
        times = [(draw(salt, request) % most + 1).alias(f"{salt}_ms") for salt, most in (("sparse", 50), ("dense", 80), ("rerank", 900))]
        models = [F.lit("hashing").alias("embedding_model"), F.lit("hashing/384").alias("index_profile_id"), F.lit("word-overlap").alias("reranker_model")]
        asked = c.scoped.join(cut, "request_id", "left").select(
            "request_id", "tenant_id", "subject", "as_of", "region", F.md5("request_id").alias("trace_id"), F.coalesce("truncated", F.lit(False)).alias("query_truncated"), *models, *times
        )
        decided = fusion.fall_back(asked, draw("vec?", request) % 10 > 0, draw("score?", request) % 10 > 0)
        return audit.execution_records(decided, c.results, 10)

    return c._once("execution", build)


def o1(c: Corpus) -> DataFrame:
    rows = executions(c).drop("plan", "as_of", "region", "k")
    return rows.withColumns({"reasons": F.array_join("reasons", ","), "documents": F.array_join("documents", ",")})


def trace() -> Column:
    return F.md5(F.floor(F.col("event_id") / 3).cast("string")).alias("trace_id")


def doc_key() -> Column:
    return F.concat(F.lit("doc-"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("key")


def events_by_kind(c: Corpus) -> dict[str, DataFrame]:
    """The seven kinds of audit events, each from the operation that causes it."""
    events = c.given("events")
    tenants = broadcast_if_small(c.principals.select("subject", "tenant_id"))
    reads = events.select("event_id", drawn("who", EVENT, *QUERY_PRINCIPALS, UNKNOWN).alias("subject"), doc_key(), trace())
    decided = access.read_decisions(reads, c.principals, c.active).join(tenants, "subject", "left")
    seen = access.visible_versions(c.candidates.select(*CHUNK, *access.LABELS), c.principals)
    listed = access.listing_pages(seen, LISTING_PAGE).groupBy("subject", "page").agg(F.count(F.lit(1)).alias("chunk_count")).join(tenants, "subject")
    pages = listed.select("tenant_id", F.col("subject").alias("principal_id"), F.md5(F.concat_ws(":", "subject", "page")).alias("trace_id"), "chunk_count", F.lit(False).alias("scoped"))
    admin = F.concat("tenant_id", F.lit("-admin")).alias("principal_id")
    submitted = versions.submissions(c).select("tenant_id", admin, F.md5("job_id").alias("trace_id"), "job_id", "ordinal", "key")
    status = F.try_element_at(F.create_map(*[F.lit(x) for x in ("click", "active", "view", "disabled", "purchase", "deleted")]), F.col("event_type"))
    tenant = F.when(draw("side", EVENT) % 5 == 0, "external").otherwise("northstar").alias("tenant_id")
    changes = events.select("event_id", tenant, doc_key(), status.alias("status"), trace()).where("status is not null").withColumn("principal_id", admin)
    asked = answers.exchanges(c).select("exchange_id", "case_id").join(c.cases.select("case_id", F.col("principal").alias("subject")), "case_id").join(tenants, "subject")
    counts = answers.prompts(c).select("exchange_id", F.col("evidence").alias("evidence_count")), answers.parsed(c).select("exchange_id", F.coalesce("rejected", F.lit(0)).alias("rejected"))
    ended = answers.answered(c).select("exchange_id", "status", F.size("statements").alias("statement_count"))
    told = asked.join(ended, "exchange_id").join(counts[0], "exchange_id", "left").join(counts[1], "exchange_id", "left").na.fill(0, ["evidence_count", "rejected"])
    told = told.select(
        "tenant_id", F.col("subject").alias("principal_id"), F.md5("exchange_id").alias("trace_id"), F.col("case_id").alias("execution_id"), "status", "evidence_count", "statement_count",
        F.col("rejected").alias("rejected_statements"), F.lit("recorded").alias("chat_model"), F.lit("answer/1").alias("prompt_version"),
    )
    return {
        "search": audit.search_events(executions(c)), "read": audit.read_events(decided), "list": audit.listing_events(pages), "submit": audit.ingestion_events(submitted),
        "change": audit.change_events(changes), "answer": audit.answer_events(told), "purge": audit.purge_events(purged(c)),
    }


def o2(c: Corpus) -> DataFrame:
    return reduce(DataFrame.unionByName, events_by_kind(c).values())


def now_of(c: Corpus) -> Column:
    latest = c.given("events").agg(F.max("ts")).first()[0]
    return F.to_timestamp(F.lit(str(latest)))


def o3(c: Corpus) -> DataFrame:
    rows = loadrows.audit(c)
    stored = rows.select(F.col("event_id").alias("execution_id"), "tenant_id", "principal_id")
    lookups = rows.select("event_id", (F.col("event_id") - draw("own", EVENT) % 2).alias("execution_id"), "tenant_id", "principal_id")
    return audit.owner_lookup(lookups, stored).select("event_id", "execution_id", "found")


def o3_job(c: Corpus) -> DataFrame:
    """Jobs asked for by drawn tenants."""
    events = c.given("events")
    jobs = versions.v14(c).select("job_id", F.when(F.col("job_id") % 10 == 0, "external").otherwise("northstar").alias("tenant_id"), "state")
    lookups = events.select("event_id", F.col("user_id").alias("job_id"), drawn("asker", EVENT, "external", "northstar", "northstar").alias("tenant_id"))
    return audit.job_lookup(lookups, jobs)


def o4(c: Corpus) -> DataFrame:
    """Both audit tables exported up to a time, with the hash of their manifests and how many files read back as something else."""
    through = F.to_timestamp(F.lit(THROUGH))
    moment = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=(draw("when", F.concat_ws(":", "request_id", "strategy")) % 1_728_000).cast("decimal(18,6)"))
    told = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    tables = {
        "audit_event": (loadrows.audit(c).withColumn("moment", told), ["occurred_at", "event_id"], ["event_id", "moment", "tenant_id", "principal_id", "action", "trace_id", "props"]),
        "query_execution": (executions(c).withColumn("occurred_at", moment).withColumn("moment", told), ["occurred_at", "request_id", "strategy"], ["request_id", "moment", "tenant_id", "principal_id", "strategy", "plan_hash", "status", "result_count"]),
    }
    out = []
    for name, (rows, order, fields) in tables.items():
        place = folder(c, f"export-{name}")
        due = audit.export_through(rows, through, now_of(c))
        manifest = files.export_ndjson(due, order, place, EXPORT_FILE_BYTES, fields)
        changed = files.export_differences(manifest, c.spark, place).count()
        whole = manifest.agg(F.count("file_no").alias("files"), F.sum("rows").alias("rows"), F.max("manifest_digest").alias("manifest_hash"))
        out.append(whole.select(F.lit(name).alias("table_name"), F.lit(THROUGH).alias("through"), "files", "rows", "manifest_hash", F.lit(changed).cast("bigint").alias("changed")))
    return out[0].unionByName(out[1])


def cutoffs(c: Corpus) -> DataFrame:
    tables = c.spark.createDataFrame([("audit_event", 20, True), ("query_execution", 5, False), ("audit_export", None, False), ("answer", 20, True)], "table_name string, retention_days int, needs_export boolean")
    exports = loadrows.audit(c).groupBy(F.lit("audit_event").alias("table_name")).agg((F.min("occurred_at") + F.expr("interval 3 days")).alias("through"))
    return audit.retention_cutoffs(tables, exports, now_of(c))


def purged(c: Corpus) -> DataFrame:
    """What the cut-offs of O5 remove, in batches: audit rows and executions; answers may not go without an export."""
    rows = loadrows.audit(c).select(F.lit("audit_event").alias("table_name"), "occurred_at", "event_id")
    executed = loadrows.requests(c).select(F.lit("query_execution").alias("table_name"), F.col("ts").alias("occurred_at"), "event_id")
    told = loadrows.audit(c).where("action = 'query.answer'").select(F.lit("answer").alias("table_name"), "occurred_at", "event_id")
    return audit.purge_batches(rows.unionByName(executed).unionByName(told), cutoffs(c), ["occurred_at", "event_id"])


def o6(c: Corpus) -> DataFrame:
    return purged(c).select("table_name", text_time("cut_off"), F.col("batch").cast("bigint").alias("batch"), "removed", text_time("oldest"), text_time("newest"))


def o7(c: Corpus) -> DataFrame:
    now = now_of(c)
    one = audit.storage_gauges(loadrows.audit(c), now).withColumn("table_name", F.lit("audit_event"))
    kept = audit.remaining(loadrows.audit(c), F.to_timestamp(F.lit(THROUGH)))
    two = audit.storage_gauges(kept, now).withColumn("table_name", F.lit("audit_event after purge"))
    return one.unionByName(two)


def o8(c: Corpus) -> DataFrame:
    attributes = F.map_from_arrays(
        F.array(F.lit("retrieval.k"), F.lit("query.text"), F.lit("status"), F.lit("user.id")),
        F.array(F.get_json_object("props", "$.k"), F.lit("private words"), F.col("event_type"), F.col("user_id").cast("string")),
    )
    spans = c.given("events").select("event_id", attributes.alias("attributes"), F.array("props").alias("events"), F.lit("boom").alias("status_text"))
    kept = audit.redact(spans)
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return kept.withColumn("attributes", F.array_join(pairs, ","))


def o9(c: Corpus) -> DataFrame:
    """Audit rows and executions by trace; drawn audit rows were lost."""
    audits = loadrows.audit(c).where(draw("lost", EVENT) % 40 > 0).select("trace_id")
    rows = loadrows.requests(c).where(F.col("trace_id").isNotNull()).select("trace_id")
    return audit.trace_differences(audits, rows)


CAUSES = [*audit.FAILURES, "bug"]


def o10(c: Corpus) -> DataFrame:
    return audit.failure_histogram(c.given("events").where("event_type = 'error'").select(drawn("cause", EVENT, *CAUSES).alias("cause")))


QUERIES = {
    "o1_execution_records": o1,
    "o2_audit_events": o2,
    "o3_owner_lookup": o3,
    "o3_job_lookup": o3_job,
    "o4_audit_export_batch": o4,
    "o5_retention_cutoff": lambda c: cutoffs(c).select("table_name", text_time("cut_off")),
    "o6_audit_purge": o6,
    "o7_audit_storage_gauges": o7,
    "o8_redact_attributes": o8,
    "o9_trace_join": o9,
    "o10_failure_histogram": o10,
}

_STRATEGIES = "['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank']"
AUDIT_SQL = {
    "audit_row": loadrows.AUDIT_SQL,
    "load_request": loadrows.REQUEST_SQL,
    "decided": f"""
        select *, case when strategy = 'dense-only' and not v then 'failed' when reasons <> '' then 'degraded' else 'ok' end as status from (
            select request_id, tenant_id, subject, strategy, v, concat_ws(',', case when strategy like 'hybrid%' and not v then 'dense_unavailable' end, case when strategy = 'hybrid-rrf-rerank' and not s then 'rerank_unavailable' end) as reasons
            from (select request_id, tenant_id, subject, unnest({_STRATEGIES}) as strategy, {h('vec?', 'request_id')} % 10 > 0 as v, {h('score?', 'request_id')} % 10 > 0 as s from scoped_request))""",
    "cut_query": f"""
        select request_id, {words('query')} > greatest(509 - longest, 0) as truncated
        from scoped_request join (select t.request_id, max(k.word_count) as longest from hybrid_top t join candidate k using (key, ordinal) group by all) using (request_id)""",
    "execution": f"""
        select request_id, tenant_id, subject as principal_id, md5(request_id) as trace_id, strategy, substr(sha256({PLAN_SQL}), 1, 16) as plan_hash, 'abac/1' as policy_version,
            case when dense then 'hashing' end as embedding_model, case when dense then 'hashing/384' end as index_profile_id, case when reranked then 'word-overlap' end as reranker_model,
            case when reranked then coalesce(truncated, false) end as query_truncated, status, reasons, coalesce(n, 0)::BIGINT as result_count, coalesce(documents, []::VARCHAR[]) as documents,
            coalesce(s_ms, 0) + coalesce(d_ms, 0) + coalesce(r_ms, 0) as total_ms, s_ms as sparse_ms, d_ms as dense_ms, r_ms as rerank_ms, as_of, region
        from (select *, case when strategy <> 'dense-only' then {h('sparse', 'request_id')} % 50 + 1 end as s_ms, case when dense then {h('dense', 'request_id')} % 80 + 1 end as d_ms,
                case when reranked then {h('rerank', 'request_id')} % 900 + 1 end as r_ms
            from (select d.*, 10 as k, as_of, region, strategy <> 'sparse-only' and v as dense, strategy = 'hybrid-rrf-rerank' and not contains(reasons, 'rerank') as reranked from decided d join (select request_id, as_of, region from scoped_request) using (request_id)))
        left join cut_query using (request_id)
        left join (select request_id, strategy, sum(n) as n, list(document order by first, document) as documents
            from (select request_id, strategy, key || '@v' || version_no as document, min(rank) as first, count(*) as n from result group by all) group by all) using (request_id, strategy)""",
    "readable": f"select p.subject, v.key, v.version_no from principal p join active_version v on {authorized('p', 'v')}",
    "decided_read": f"""
        select subject, key, tenant_id, version_no, trace_id from (select {one_of('who', 'event_id', *QUERY_PRINCIPALS, UNKNOWN)} as subject, 'doc-' || lpad(user_id::VARCHAR, 7, '0') as key, md5((event_id // 3)::VARCHAR) as trace_id from events)
        left join readable using (subject, key) left join (select subject, tenant_id from principal) using (subject)""",
    "listed_page": f"""
        select subject, tenant_id, page, count(*) as n from (select p.subject, p.tenant_id, (row_number() over (partition by subject order by k.key, k.version_no, k.ordinal) - 1) // {LISTING_PAGE} + 1 as page
            from candidate k join principal p on {authorized('p', 'k')}) group by all""",
    "changed": f"""
        select case when {h('side', 'event_id')} % 5 = 0 then 'external' else 'northstar' end as tenant_id, 'doc-' || lpad(user_id::VARCHAR, 7, '0') as key, md5((event_id // 3)::VARCHAR) as trace_id,
            case event_type when 'click' then 'active' when 'view' then 'disabled' when 'purchase' then 'deleted' end as status from events where event_type in ('click', 'view', 'purchase')""",
    "told": """
        select a.exchange_id, a.case_id, p.tenant_id, p.subject, a.status, coalesce(n, 0) as evidence, case when a.status = 'answered' then a.kept else 0 end as statements, coalesce(r.rejected, 0) as rejected
        from answer_row a join eval_case e using (case_id) join principal p on p.subject = e.principal
        left join (select exchange_id, count(*) as n from context_row group by all) using (exchange_id) left join parsed_reply r using (exchange_id)""",
    "cutoff": """
        select 'audit_event' as table_name, least(max(ts) - interval 20 days, min(ts) + interval 3 days) as cut_off from events
        union all select 'query_execution', max(ts) - interval 5 days from events""",
    "purge_batch": """
        select table_name, cut_off, (n - 1) // 1000 + 1 as batch, count(*) as removed, min(ts) as oldest, max(ts) as newest
        from (select *, row_number() over (partition by table_name order by ts, event_id) as n from events join cutoff on true where ts < cut_off) group by all""",
}


def _tree(rows: str) -> str:
    """The digest tree of (n, line) rows whose files and blocks hold fewer lines than a node has children."""
    return f"""
        select count(*) as files, sum(n)::BIGINT as rows, sha256(string_agg(digest, '' order by file_no)) as manifest_hash from (
            select file_no, count(*) as n, sha256(string_agg(sha256(line), '' order by n)) as digest
            from (select n, line, (sum(strlen(line) + 1) over (order by n) - strlen(line) - 1) // {EXPORT_FILE_BYTES} as file_no from ({rows})) group by file_no)"""


_MOMENT = "strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f')"
AUDIT_LINES = f"""
    select row_number() over (order by occurred_at, event_id) as n, to_json({{'event_id': event_id, 'moment': {_MOMENT}, 'tenant_id': tenant_id, 'principal_id': principal_id, 'action': action, 'trace_id': trace_id, 'props': props}})::VARCHAR as line
    from audit_row where occurred_at < timestamp '{THROUGH}'"""
EXECUTION_LINES = f"""
    select row_number() over (order by occurred_at, request_id, strategy) as n, to_json({{'request_id': request_id, 'moment': {_MOMENT}, 'tenant_id': tenant_id, 'principal_id': principal_id, 'strategy': strategy, 'plan_hash': plan_hash,
        'status': status, 'result_count': result_count}})::VARCHAR as line
    from (select *, timestamp '2024-01-01' + to_seconds({h('when', "(request_id || ':' || strategy)")} % 1728000) as occurred_at from execution) where occurred_at < timestamp '{THROUGH}'"""
SQL = {
    "audit_row": loadrows.AUDIT_SQL,
    "load_request": loadrows.REQUEST_SQL,
    "decided": f"""
        select *, case when strategy = 'dense-only' and not v then 'failed' when reasons <> '' then 'degraded' else 'ok' end as status from (
            select request_id, tenant_id, subject, strategy, v, concat_ws(',', case when strategy like 'hybrid%' and not v then 'dense_unavailable' end, case when strategy = 'hybrid-rrf-rerank' and not s then 'rerank_unavailable' end) as reasons
            from (select request_id, tenant_id, subject, unnest({_STRATEGIES}) as strategy, {h('vec?', 'request_id')} % 10 > 0 as v, {h('score?', 'request_id')} % 10 > 0 as s from scoped_request))""",
    "execution": f"""
        select request_id, tenant_id, subject as principal_id, strategy, substr(sha256({PLAN_SQL}), 1, 16) as plan_hash, 'abac/1' as policy_version, status, reasons, coalesce(n, 0)::BIGINT as result_count,
            coalesce(documents, []::VARCHAR[]) as documents
        from (select *, 10 as k from decided) left join (select request_id, strategy, sum(n) as n, list(document order by first, document) as documents
            from (select request_id, strategy, key || '@v' || version_no as document, min(rank) as first, count(*) as n from result group by all) group by all) using (request_id, strategy)""",
    "readable": f"select p.subject, v.key, v.version_no from principal p join active_version v on {authorized('p', 'v')}",
    "decided_read": f"""
        select subject, key, tenant_id, version_no from (select {one_of('who', 'event_id', *QUERY_PRINCIPALS)} as subject, 'doc-' || lpad(user_id::VARCHAR, 7, '0') as key from events where event_type = 'view')
        left join readable using (subject, key) join (select subject, tenant_id from principal) using (subject)""",
}
SQL = {
    "o1_execution_records": sql(
        """select request_id, tenant_id, principal_id, trace_id, strategy, plan_hash, policy_version, embedding_model, index_profile_id, reranker_model, query_truncated, status, reasons, result_count,
            array_to_string(documents, ',') as documents, total_ms, sparse_ms, dense_ms, rerank_ms from execution""",
        **AUDIT_SQL,
    ),
    "o2_audit_events": sql(
        """select request_id as resource_id, tenant_id, principal_id, 'retrieval.search' as action, 'query_execution' as resource_type, 'allow' as decision, policy_version, trace_id,
            to_json({'strategy': strategy, 'k': 10, 'planHash': plan_hash, 'resultCount': result_count, 'documents': documents, 'degraded': list_filter(string_split(reasons, ','), lambda x: x <> ''),
                'asOf': strftime(as_of, '%Y-%m-%dT%H:%M:%SZ'), 'region': region})::VARCHAR as attributes from execution
        union all select key, tenant_id, subject, 'document.read', 'document', case when version_no is null then 'deny' else 'allow' end, 'abac/1', trace_id, '{}' from decided_read
        union all select tenant_id, tenant_id, subject, 'retrieval.list_chunks', 'chunk_listing', 'allow', 'abac/1', md5(subject || ':' || page), to_json({'chunkCount': n, 'scoped': false})::VARCHAR from listed_page
        union all select job_id, tenant_id, tenant_id || '-admin', 'ingestion.submit', 'ingestion_job', 'allow', null, md5(job_id), to_json({'documents': list(key order by ordinal, key)})::VARCHAR from submitted group by tenant_id, job_id
        union all select key, tenant_id, tenant_id || '-admin', case when status = 'deleted' then 'document.delete' else 'document.status' end, 'document', 'allow', null, trace_id, to_json({'status': status})::VARCHAR from changed
        union all select case_id, tenant_id, subject, 'query.answer', 'query_execution', 'allow', 'abac/1', md5(exchange_id), to_json({'status': status, 'evidenceCount': evidence, 'statementCount': statements,
            'rejectedStatements': rejected, 'chatModel': 'recorded', 'promptVersion': 'answer/1'})::VARCHAR from told
        union all select table_name, '', 'system:audit-cleanup', 'audit.purge', 'audit_table', 'allow', null, '', to_json({'table': table_name, 'cutOff': strftime(cut_off, '%Y-%m-%dT%H:%M:%SZ'), 'rows': removed})::VARCHAR from purge_batch""",
        **(answers.ANSWER_SQL | versions.PLAN_SQL | AUDIT_SQL),
    ),
    "o3_job_lookup": f"""
        select event_id, user_id as job_id, tenant_id, case when tenant_id = case when user_id % 10 = 0 then 'external' else 'northstar' end then state end as state
        from (select event_id, user_id, {one_of('asker', 'event_id', 'external', 'northstar', 'northstar')} as tenant_id from events) join ({versions.SQL['v14_cascade_job_state']}) s on s.job_id = user_id""",
    "o3_owner_lookup": sql(
        f"""select a.event_id, a.event_id - {h('own', 'a.event_id')} % 2 as execution_id, b.event_id is not null as found
        from audit_row a left join audit_row b on b.event_id = a.event_id - {h('own', 'a.event_id')} % 2 and b.tenant_id = a.tenant_id and b.principal_id = a.principal_id""",
        **AUDIT_SQL,
    ),
    "o4_audit_export_batch": sql(
        f"""select 'audit_event' as table_name, '{THROUGH}' as through, *, 0::BIGINT as changed from ({_tree(AUDIT_LINES)})
        union all select 'query_execution', '{THROUGH}', *, 0::BIGINT from ({_tree(EXECUTION_LINES)})""",
        **AUDIT_SQL,
    ),
    "o5_retention_cutoff": """
        select table_name, strftime(cut_off, '%Y-%m-%d %H:%M:%S') as cut_off from (
            select 'audit_event' as table_name, least(max(ts) - interval 20 days, min(ts) + interval 3 days) as cut_off from events
            union all select 'query_execution', max(ts) - interval 5 days from events union all select 'audit_export', null union all select 'answer', null)""",
    "o6_audit_purge": sql(
        """select table_name, strftime(cut_off, '%Y-%m-%d %H:%M:%S') as cut_off, batch, removed, strftime(oldest, '%Y-%m-%d %H:%M:%S') as oldest, strftime(newest, '%Y-%m-%d %H:%M:%S') as newest from purge_batch""", **AUDIT_SQL
    ),
    "o7_audit_storage_gauges": f"""
        select 'audit_event' as table_name, count(*) as rows, (floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT) as oldest_seconds from events
        union all select 'audit_event after purge', count(*), (select floor(epoch(max(ts)))::BIGINT from events) - floor(epoch(min(ts)))::BIGINT from events where ts >= timestamp '{THROUGH}'""",
    "o8_redact_attributes": "select event_id, 'retrieval.k=' || (props->>'k') || ',status=' || event_type as attributes from events",
    "o9_trace_join": sql(
        f"""select trace_id, coalesce(a, 0) as audits, coalesce(e, 0) as executions, case when a is null then 'no audit event' when e is null then 'no execution' else 'matched' end as side
        from (select trace_id, count(*) as a from audit_row where {h('lost', 'event_id')} % 40 > 0 group by all) full join (select trace_id, count(*) as e from load_request where trace_id is not null group by all) using (trace_id)""",
        **AUDIT_SQL,
    ),
    "o10_failure_histogram": f"""
        select case cause when 'model_down' then 'MODEL_SERVICE_UNAVAILABLE' when 'database_transient' then 'DATABASE_UNAVAILABLE' when 'model_rejected' then 'MODEL_SERVICE_REJECTED'
            when 'model_invalid' then 'MODEL_RESPONSE_INVALID' when 'text_too_long' then 'MODEL_RESPONSE_INVALID' when 'profile_mismatch' then 'INDEX_PROFILE_MISMATCH' else 'INTERNAL_ERROR' end as code,
            cause in ('model_down', 'database_transient') as retryable, count(*) as failures
        from (select {one_of('cause', 'event_id', *CAUSES)} as cause from events where event_type = 'error') group by all""",
}
