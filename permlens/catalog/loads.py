"""Load runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog import loadrows
from permlens.catalog.metrics import EVAL_SQL, rounded
from permlens.catalog.sql import h, one_of, sql
from permlens.functions.hashing import draw
from permlens.functions.labels import clearance_rank
from permlens.operators import access, generate, loads, metrics
from permlens.operators.fusion import STRATEGIES
from permlens.operators.numbering import number_rows
from permlens.plans.corpus import Corpus
from permlens.sources.tables import QUERY_PRINCIPALS

EVENT = "event_id"


def l4(c: Corpus) -> DataFrame:
    rows = loadrows.requests(c)
    timed = metrics.nearest_rank(rows, ["strategy"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return loads.load_summary(rows, timed.withColumnRenamed("largest", "max_ms").drop("n"))


def l6(c: Corpus) -> DataFrame:
    cases = number_rows(c.cases.select("case_id"), [], ["case_id"], "n")
    total = c.cases.count()
    return loads.expected_requests(cases, total, list(STRATEGIES), total * 10)


def generated(c: Corpus) -> DataFrame:
    """As many generated documents as the folder has documents."""
    return c._once("generated", lambda: generate.labelled_corpus(c.given("documents").select(F.col("doc_id").alias("number")), "distractor"))


def l7(c: Corpus) -> DataFrame:
    """Hand-kept visibility with that of the stricter rule over the given documents added."""
    stricter = access.stricter_visibility(c.all_principals, c.current).select(F.col("subject").alias("principal"), F.col("key").alias("document"))
    return loads.union_visibility(c.listed_visibility, stricter)


def l9(c: Corpus) -> DataFrame:
    rows = loadrows.requests(c).withColumn("size", draw("size", EVENT) % 3 * 1000).withColumn("workers", F.when(draw("work", EVENT) % 2 == 0, 1).otherwise(16).cast("bigint"))
    group = ["size", "workers", "strategy"]
    timed = metrics.nearest_rank(rows, group, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).select(*group, "p50_ms", "p95_ms")
    runs = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("requests")).join(timed, group)
    totals = rows.groupBy("size", "workers").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("size", "workers", F.lit("before").alias("label"), (F.col("size") * 437).alias("bytes"), F.col("size").alias("rows"))
    after = totals.where("not (size = 2000 and workers = 16)").select(
        "size", "workers", F.lit("after").alias("label"), (F.col("size") * 437 + F.col("n") * 874).alias("bytes"), (F.col("size") + F.col("n") * 2).alias("rows")
    )
    slow = rows.where(F.size("degraded") > 0)
    stages = metrics.nearest_rank(slow, group, "latency_ms", {"stage_p50_ms": 0.5, "stage_p95_ms": 0.95}).select(*group, "stage_p50_ms", "stage_p95_ms")
    return loads.scale_summary(runs, before.unionByName(after), stages)


def l10(c: Corpus) -> DataFrame:
    rows = c.given("events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")))
    executions = rows.select(
        F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (draw("strat", EVENT) % 4).cast("int") + 1).alias("strategy"),
        F.get_json_object("props", "$.k").cast("double").alias("dense"),
        F.round("value", 1).alias("total"),
    )
    names = ["dense_p50", "dense_p95", "total_p50", "total_p95"]
    return rounded(loads.stage_percentiles(executions, ["dense", "total"]), *names)


def l11(c: Corpus) -> DataFrame:
    rows = generated(c)
    return rows.select(
        "key", "tenant_id", "classification", F.array_join("allowed_departments", ",").alias("departments"), F.array_join("required_projects", ",").alias("projects"), F.md5("content").alias("content")
    )


QUERIES = {
    "l4_load_summary": l4,
    "l5_load_totals": lambda c: rounded(loads.load_totals(loadrows.requests(c)), "requests_per_second"),
    "l6_expected_requests": l6,
    "l7_union_visibility": l7,
    "l8_as_principal": lambda c: loads.as_each_principal(c.cases.select("case_id", "split"), QUERY_PRINCIPALS),
    "l9_scale_summary": l9,
    "l10_stage_percentiles": l10,
    "l11_labelled_corpus_generator": l11,
}

_GROUP = "size, workers, strategy"
LOAD_SQL = EVAL_SQL | {
    "load_request": loadrows.REQUEST_SQL,
    "sized": f"select *, {h('size', 'event_id')} % 3 * 1000 as size, case when {h('work', 'event_id')} % 2 = 0 then 1 else 16 end::BIGINT as workers from load_request",
    "generated_section": f"""
        select key, s, k, {one_of('heading', 'k', *generate.HEADINGS)} as heading,
            ceil(case when {h('long', 'k')} % 10 = 0 then 420 + {h('words', 'k')} % 281 else 40 + {h('words', 'k')} % 161 end / {generate.SENTENCE_WORDS})::BIGINT as n
        from (select key, s, key || '/' || s as k from (select 'distractor-' || lpad(doc_id::VARCHAR, 9, '0') as key from documents), lateral (select unnest(range(1, ({h('sections', 'key')} % 5 + 4)::BIGINT)) as s))""",
    "generated_sentence": f"""
        select key, s, heading, i, {one_of('g1', 'x', *generate.SUBJECTS)} || ' ' || {one_of('g2', 'x', *generate.VERBS)} || ' ' || {one_of('g3', 'x', *generate.OBJECTS)} || ' ' || {one_of('g4', 'x', *generate.TIMES)}
            || '.' || case when i % 5 = 0 then chr(10) || chr(10) else ' ' end as said
        from (select key, s, heading, i, k || ':' || i as x from generated_section, lateral (select unnest(range(1, n + 1)) as i))""",
    "generated_text": """
        select key, string_agg('## ' || heading || chr(10) || chr(10) || said, chr(10) || chr(10) order by s) as body
        from (select key, s, heading, string_agg(said, '' order by i) as said from generated_sentence group by all) group by key""",
    "generated_row": f"""
        select key, tenant_id, case when c < 15 then 'public' when c < 75 then 'internal' when c < 90 then 'confidential' else 'restricted' end as classification,
            case when c < 15 then 0 when c < 75 then 1 when c < 90 then 2 else 3 end as classification_rank,
            case when {h('gdept?', 'key')} % 100 < 15 then [{one_of('gdept', 'key', 'engineering', 'support', 'sales')}] else []::VARCHAR[] end as allowed_departments,
            case when tenant_id <> 'northstar' then []::VARCHAR[] when p < 2 then ['atlas'] when p < 4 then ['borealis'] else []::VARCHAR[] end as required_projects, doc_id
        from (select doc_id, key, case when {h('gtenant', 'key')} % 100 < 10 then 'external' else 'northstar' end as tenant_id, {h('gclass', 'key')} % 100 as c, {h('gproj', 'key')} % 100 as p
            from (select doc_id, 'distractor-' || lpad(doc_id::VARCHAR, 9, '0') as key from documents))""",
}


def load_sql(query: str) -> str:
    return sql(query, **LOAD_SQL)


_NEAREST = "max(latency_ms) filter (n = least(total - 1, floor(total * 0.5)) + 1) as p50_ms, max(latency_ms) filter (n = least(total - 1, floor(total * 0.95)) + 1) as p95_ms"
SQL = {
    "l4_load_summary": load_sql(
        f"""select strategy, requests, violations, statuses, coalesce(degraded, '') as degraded, p50_ms, p95_ms, max_ms from (
            select strategy, count(*) as requests, sum(violations)::BIGINT as violations, {_NEAREST}, max(latency_ms) as max_ms
            from (select *, row_number() over (partition by strategy order by latency_ms) as n, count(*) over (partition by strategy) as total from load_request) group by strategy)
        join (select strategy, string_agg(name || ':' || n, ',' order by name) as statuses from (select strategy, concat_ws(' ', status::VARCHAR, code) as name, count(*) as n from load_request group by all) group by strategy) using (strategy)
        left join (select strategy, string_agg(reason || ':' || n, ',' order by reason) as degraded from (select strategy, reason, count(*) as n from load_request where reason is not null group by all) group by strategy) using (strategy)"""
    ),
    "l5_load_totals": load_sql(
        """select count(*) as requests, count(*) filter (status <> 200) as failed, count(reason) as degraded, sum(violations)::BIGINT as violations,
            round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) as requests_per_second, count(trace_id) - count(distinct trace_id) as repeated_trace_ids from load_request"""
    ),
    "l6_expected_requests": load_sql(
        """select request_no, c.case_id, s.strategy from (select unnest(range(10 * (select count(*) from eval_case))) as request_no) r
        join (select case_id, row_number() over (order by case_id) - 1 as n, count(*) over () as total from eval_case) c on c.n = r.request_no // 4 % c.total
        join (select unnest(['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank']) as strategy, unnest([0, 1, 2, 3]) as i) s on s.i = r.request_no % 4"""
    ),
    "l7_union_visibility": load_sql(
        """select principal, document, bool_or(generated) as generated from (select principal, document, false as generated from listed_pair
        union all select p.subject, v.key, true from principal_all p join current_version v on p.tenant_id = v.tenant_id and p.role <> 'admin' and v.classification_rank <= p.clearance_rank
            and (len(v.allowed_departments) = 0 or coalesce(list_contains(v.allowed_departments, p.department), false)) and list_has_all(p.projects, v.required_projects)) group by all"""
    ),
    "l8_as_principal": load_sql("select case_id, split, subject as principal from eval_case join principal on true"),
    "l9_scale_summary": load_sql(
        f"""select {_GROUP}, requests, p50_ms, p95_ms, stage_p50_ms, stage_p95_ms,
            case when not (size = 2000 and workers = 16) then round((size + total * 2 - size) * 1000 / total) end::DOUBLE as audit_rows_per_1000,
            case when not (size = 2000 and workers = 16) then round(total * 874 * 1000 / total / 1024) end::DOUBLE as audit_kib_per_1000
        from (select {_GROUP}, count(*) as requests, {_NEAREST}, {_NEAREST.replace('n =', 'reason is not null and m =').replace('total', 'slow').replace('as p', 'as stage_p')}
            from (select *, row_number() over (partition by {_GROUP} order by latency_ms) as n, count(*) over (partition by {_GROUP}) as total,
                row_number() over (partition by {_GROUP}, reason is not null order by latency_ms) as m, count(reason) over (partition by {_GROUP}) as slow from sized) group by all)
        join (select size, workers, count(*) as total from sized group by all) using (size, workers)"""
    ),
    "l10_stage_percentiles": f"""
        select strategy, count(*) as executions, round(quantile_cont(dense, 0.5), 6) as dense_p50, round(quantile_cont(dense, 0.95), 6) as dense_p95, round(quantile_cont(total, 0.5), 6) as total_p50,
            round(quantile_cont(total, 0.95), 6) as total_p95
        from (select (['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank'])[({h('strat', 'event_id')} % 4 + 1)::INT] as strategy, (props->>'k')::DOUBLE as dense, round(value, 1) as total
            from events where ts >= timestamp '2024-01-05') group by strategy""",
    "l11_labelled_corpus_generator": load_sql(
        """select key, tenant_id, classification, array_to_string(allowed_departments, ',') as departments, array_to_string(required_projects, ',') as projects,
            md5('# Notes ' || doc_id || chr(10) || chr(10) || body) as content from generated_row join generated_text using (key)"""
    ),
}
