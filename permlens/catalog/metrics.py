"""Evaluation metrics, checks and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog import loadrows
from permlens.catalog.access import LISTED_SQL
from permlens.catalog.retrieval import longs, recorded
from permlens.catalog.sql import h, sql, terms
from permlens.functions.hashing import draw
from permlens.operators import dataset, keyword, metrics
from permlens.plans.corpus import RUN_STRATEGIES, Corpus


def strategies():
    return F.array(*[F.lit(s) for s in RUN_STRATEGIES])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def quality(c: Corpus, *names: str) -> DataFrame:
    rows = metrics.quality(metrics.span_hits(c.run_results, c.spans, strategies()))
    return rounded(rows.select("case_id", "strategy", *names), *names)


def e1(c: Corpus) -> DataFrame:
    rows = metrics.evidence_spans(c.cases, c.current)
    return longs(rows.select("case_id", "key", "span_start", "span_end", "occurrences"), "span_start", "span_end", "occurrences")


def joint_spans(c: Corpus) -> DataFrame:
    """The evidence of up to three neighbouring cases as that of the first of them, so that cases have several spans in several documents."""
    n = F.substring("case_id", 6, 7).cast("int")
    leader = F.concat(F.lit("case-"), F.lpad((n - n % 3).cast("string"), 7, "0"))
    return c.spans.withColumns({"case_id": leader, "span_no": (n % 3).cast("int")})


def e6(c: Corpus) -> DataFrame:
    rows = metrics.quality(metrics.span_hits(c.run_results, joint_spans(c), strategies()))
    counts = joint_spans(c).groupBy("case_id").agg(F.count(F.lit(1)).alias("spans"))
    return rounded(rows.join(counts, "case_id").select("case_id", "strategy", "spans", "ndcg_10", "recall_10"), "ndcg_10", "recall_10")


def e7(c: Corpus) -> DataFrame:
    rows = c.records.where("hard_negative_above_evidence is not null")
    return longs(rows.select("case_id", "strategy", "hard_negative_rank", "hard_negative_above_evidence"), "hard_negative_rank")


def e10(c: Corpus) -> DataFrame:
    rows = c.records_of(c.run_results)
    shape = rows.select(
        "case_id", "strategy", "split", "principal", "must_abstain", "scoped", *metrics.QUALITY, "violations", "scope_failures", "reviewed",
        F.array_join("tags", ",").alias("tags"),
    )
    return rounded(shape, *metrics.QUALITY)


def e14(c: Corpus) -> DataFrame:
    rows = metrics.gate(c.records, keyword.ranking_differences(c.results.where("strategy = 'sparse-only'"), recorded(c)))
    return longs(rows, "status")


def e15(c: Corpus) -> DataFrame:
    return dataset.problems(
        c.cases, c.all_principals, c.listed_visibility, c.derived_visibility, c.labelled_current, c.spans, keyword.lexical_overlap(c.cases), c.reviewed
    )


def e18(c: Corpus) -> DataFrame:
    return metrics.nearest_rank(loadrows.requests(c), ["strategy"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("largest")


def e19(c: Corpus) -> DataFrame:
    return metrics.digest(c.cases.select("case_id", "split", "query", "principal", "must_abstain"))


def e20(c: Corpus) -> DataFrame:
    fields = ["classification", "format", "valid_from", "valid_to"]
    flat = [x for f in fields for x in (F.lit(f), F.coalesce(F.date_format(f, "yyyy-MM-dd") if f.startswith("valid") else F.col(f), F.lit("none")))]
    flat += [F.lit("labels.departments"), F.array_join("allowed_departments", ","), F.lit("content"), F.md5("content")]
    shaped = c.versions.select("key", "version_no", F.create_map(*flat).alias("fields"))
    first, last = shaped.where("version_no = 1"), shaped.join(c.current.select("key", "version_no"), ["key", "version_no"], "left_semi")
    return metrics.field_differences(first, last, "key")


def e22(c: Corpus) -> DataFrame:
    rows = loadrows.requests(c).select(
        "case", "strategy", F.struct("ts", "event_id").alias("at"), F.size("violations").alias("violations"), F.lit(0).alias("scope_failures"),
        (F.size("degraded") > 0).alias("degraded"),
    )
    return longs(metrics.select_attempts(rows), "selected", "repeats")


def e21(c: Corpus) -> DataFrame:
    return metrics.dataset_profile(c.cases, keyword.lexical_overlap(c.cases), c.reviewed)


SUMMARY = ["recall_5", "recall_10", "mrr_10", "ec_10"]
QUERIES = {
    "e1_locate_evidence": e1,
    "e2_covers": lambda c: longs(metrics.covering(c.run_results, c.spans).drop("span_no"), "rank", "ordinal"),
    "e3_recall_at_k": lambda c: quality(c, "recall_5", "recall_10"),
    "e4_mrr_at_10": lambda c: quality(c, "mrr_10"),
    "e5_evidence_coverage_at_10": lambda c: quality(c, "ec_10"),
    "e6_ndcg_at_10": e6,
    "e7_hard_negative_rank": e7,
    "e8_security_violations": lambda c: metrics.violations(c.run_results, c.cases, c.listed_visibility, c.labelled_current),
    "e9_scope_failures": lambda c: metrics.scope_failures(c.run_results, c.cases),
    "e10_case_records": e10,
    "e11_summarize_split_strategy": lambda c: rounded(metrics.summary(c.records), *SUMMARY),
    "e12_recall_by_tag": lambda c: rounded(metrics.recall_by_tag(c.records, RUN_STRATEGIES), *RUN_STRATEGIES),
    "e13_misses": lambda c: rounded(metrics.misses(c.records).select("case_id", "strategy", "recall_10", "violations"), "recall_10"),
    "e14_gate_status": e14,
    "e15_validate_dataset": e15,
    "e16_authorization_negatives": lambda c: dataset.negative_reasons(c.cases, c.principals, c.current),
    "e17_reviewed_filter": lambda c: c.records.where("reviewed").select("case_id", "strategy", "split"),
    "e18_latency_p50_p95": e18,
    "e19_dataset_digest": e19,
    "e20_manifest_differences": e20,
    "e21_dataset_profile": e21,
    "e22_select_attempt": e22,
    "e23_stratified_holdout": lambda c: metrics.stratified_holdout(c.cases, draw("holdout", F.col("case_id"))),
}

_FIVE = "['sparse-only', 'dense-only', 'hybrid-rrf', 'hybrid-rrf-rerank', 'bm25-reference']"
_BEHIND = f"({h('behind', 'key')} % 30 = 0)::INT"


def records_sql(results: str, name: str) -> dict[str, str]:
    """The record table of one set of results."""
    return {
        f"{name}_cover": f"""
            select r.request_id as case_id, r.strategy, r.rank, r.key, r.ordinal from {results} r join span s on s.case_id = r.request_id and s.key = r.key and s.version_no = r.version_no
                and r.char_start < s.span_end and s.span_start < r.char_end""",
        f"{name}_first": f"select case_id, strategy, min(rank) as first_rank from {name}_cover group by all",
        f"{name}_violation": f"""
            select case_id, strategy, violation from (select distinct r.case_id, r.strategy, case when l.document is null then r.key when r.version_no <> c.version_no then r.key || '@v' || r.version_no end as violation
                from (select distinct request_id as case_id, strategy, key, version_no from {results}) r join eval_case e using (case_id)
                left join (select distinct principal, document from listed_pair) l on l.principal = e.principal and l.document = r.key
                left join labelled_current c on c.key = r.key) where violation is not null""",
        f"{name}_failure": f"""
            select distinct r.request_id as case_id, r.strategy, r.key from {results} r join eval_case e on e.case_id = r.request_id where list_contains(e.out_of_scope_documents, r.key)""",
        f"{name}_tempted": f"""
            select e.case_id, s.strategy, min(r.rank) as hard_negative_rank from eval_case e join (select unnest({_FIVE}) as strategy) s on true
            left join {results} r on r.request_id = e.case_id and r.strategy = s.strategy and list_contains(e.hard_negative_documents, r.key) group by all""",
        name: f"""
            select e.case_id, s.strategy, e.split, e.principal, e.must_abstain, e.tags,
                len(e.out_of_scope_documents) > 0 or e.as_of is not null or e.region is not null as scoped,
                case when e.answerable then coalesce(first_rank <= 5, false)::INT end::DOUBLE as recall_5, case when e.answerable then coalesce(first_rank <= 10, false)::INT end::DOUBLE as recall_10,
                case when e.answerable then case when first_rank <= 10 then 1 / first_rank else 0 end end as mrr_10,
                case when e.answerable then case when first_rank <= 10 then 1 / log2(first_rank + 1) else 0 end end as ec_10,
                coalesce(v.n, 0) as violations, coalesce(f.n, 0) as scope_failures, e.case_id in (select 'case-' || lpad(doc_id::VARCHAR, 7, '0') from labels) as reviewed,
                hard_negative_rank, hard_negative_rank is not null and (first_rank is null or hard_negative_rank < first_rank) as hard_negative_above_evidence
            from eval_case e join (select unnest({_FIVE}) as strategy) s on true
            left join {name}_first using (case_id, strategy)
            left join (select case_id, strategy, count(*) as n from {name}_violation group by all) v using (case_id, strategy)
            left join (select case_id, strategy, count(*) as n from {name}_failure group by all) f using (case_id, strategy)
            left join {name}_tempted using (case_id, strategy)""",
    }


EVAL_SQL = LISTED_SQL | {
    "run_result": """
        select request_id, strategy, rank, key, version_no, ordinal, char_start, char_end from result
        union all select request_id, 'bm25-reference', rank, key, version_no, ordinal, char_start, char_end from bm25_hit""",
    "span": """
        select e.case_id, e.key, e.version_no, instr(t.text, e.quote) - 1 as span_start, instr(t.text, e.quote) - 1 + len(e.quote) as span_end,
            (len(t.text) - len(replace(t.text, e.quote, ''))) // len(e.quote) as occurrences from eval_case e join doc_text t using (key) where answerable""",
    "labelled_current": f"select tenant_id, key, version_no - {_BEHIND} as version_no, content from current_version",
    **records_sql("run_result", "record"),
    "band": f"""
        select case_id, case when overlap < 1 / 3 then 'low' when overlap >= 2 / 3 then 'high' else 'mid' end as band
        from (select case_id, case when len(q) = 0 then 0 else len(list_intersect(q, e)) / len(q) end as overlap
            from (select case_id, list_distinct({terms('query')}) as q, list_distinct({terms('quote')}) as e from eval_case where answerable))""",
}


def evaluated(query: str) -> str:
    return sql(query, **EVAL_SQL)


def _answerable(columns: str) -> str:
    return evaluated(f"select case_id, strategy, {columns} from record where not must_abstain")


_SUMMARY = f"""count(recall_10) as answerable_cases, {", ".join(f"round(avg({m}), 6) as {m}" for m in SUMMARY)}, count(*) as hard_negative_cases,
    count(*) filter (hard_negative_above_evidence) as hard_negative_above_evidence, sum(violations)::BIGINT as security_violations, count(*) filter (scoped) as scope_cases,
    sum(scope_failures)::BIGINT as scope_failures"""

SQL = {
    "e1_locate_evidence": evaluated("select case_id, key, span_start::BIGINT as span_start, span_end::BIGINT as span_end, occurrences::BIGINT as occurrences from span"),
    "e2_covers": evaluated("select case_id, strategy, rank::BIGINT as rank, key, ordinal::BIGINT as ordinal from record_cover"),
    "e3_recall_at_k": _answerable("recall_5, recall_10"),
    "e4_mrr_at_10": _answerable("round(mrr_10, 6) as mrr_10"),
    "e5_evidence_coverage_at_10": _answerable("round(ec_10, 6) as ec_10"),
    "e6_ndcg_at_10": evaluated(
        f"""select case_id, strategy, count(*) as spans, round(count(*) filter (first_rank <= 10) / count(*), 6) as recall_10,
            round(coalesce(list_sum(list_transform(list_distinct(list(first_rank) filter (first_rank <= 10)), lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg_10
        from (select j.case_id, s.strategy, j.key, min(r.rank) as first_rank
            from (select 'case-' || lpad((substr(case_id, 6)::INT - substr(case_id, 6)::INT % 3)::VARCHAR, 7, '0') as case_id, key, version_no, span_start, span_end from span) j join (select unnest({_FIVE}) as strategy) s on true
            left join run_result r on r.request_id = j.case_id and r.strategy = s.strategy and r.key = j.key and r.version_no = j.version_no and r.char_start < j.span_end and j.span_start < r.char_end group by all)
        group by case_id, strategy"""
    ),
    "e7_hard_negative_rank": evaluated("select case_id, strategy, hard_negative_rank, hard_negative_above_evidence from record"),
    "e8_security_violations": evaluated("select case_id, strategy, violation from record_violation"),
    "e9_scope_failures": evaluated("select case_id, strategy, key from record_failure"),
    "e10_case_records": evaluated(
        """select case_id, strategy, split, principal, must_abstain, scoped, recall_5, recall_10, round(mrr_10, 6) as mrr_10, round(ec_10, 6) as ec_10, violations, scope_failures, reviewed,
            array_to_string(tags, ',') as tags from record"""
    ),
    "e11_summarize_split_strategy": evaluated(
        f"""select split, strategy, case when reviewed then 'reviewed' else 'not reviewed' end as labels, {_SUMMARY} from record group by split, strategy, reviewed
        union all select split, strategy, 'all', {_SUMMARY} from record group by split, strategy"""
    ),
    "e12_recall_by_tag": evaluated(
        "select tag, count(*) filter (strategy = 'sparse-only') as cases, "
        + ", ".join(f"round(avg(recall_10) filter (strategy = '{s}'), 6) as \"{s}\"" for s in RUN_STRATEGIES)
        + " from (select *, unnest(tags) as tag from record where not must_abstain) group by tag"
    ),
    "e13_misses": evaluated("select case_id, strategy, recall_10, violations from record where recall_10 < 1 or violations > 0"),
    "e14_gate_status": evaluated(
        f"""select *, case when violations > 0 then 2 when scope_failures > 0 then 3 when changed_rankings > 0 then 4 else 0 end::BIGINT as status from (
            select sum(violations)::BIGINT as violations, sum(scope_failures)::BIGINT as scope_failures,
                (select count(distinct request_id) from sparse_top where {h('record', 'request_id')} % 10 <= 1) as changed_rankings from record)"""
    ),
    "e15_validate_dataset": evaluated(
        """select case_id as subject, 'evidence is not visible' as problem, key as detail from eval_case e where answerable and (principal, key) not in (select principal, document from listed_pair)
        union all select case_id, 'evidence cites another version', e.key from eval_case e join labelled_current c using (key)
            where answerable and (principal, e.key) in (select principal, document from listed_pair) and c.version_no <> e.version_no
        union all select case_id, 'listed as unauthorized but visible', d from (select case_id, principal, unnest(unauthorized_documents) as d from eval_case) where (principal, d) in (select principal, document from listed_pair)
        union all select case_id, 'unknown hard negative', d from (select case_id, unnest(hard_negative_documents) as d from eval_case) where d not in (select key from manifest)
        union all select case_id, 'out of scope but not visible', d from (select case_id, principal, unnest(out_of_scope_documents) as d from eval_case) where (principal, d) not in (select principal, document from listed_pair)
        union all select 'dataset', 'too few low-overlap paraphrases', low::VARCHAR from (select count(*) filter (band = 'low') as low, count(*) as n from band) where n > 0 and low < 0.3 * n
        union all select 'dataset', 'too few authorization negatives', n::VARCHAR from (select count(*) filter (len(unauthorized_documents) > 0) as n from eval_case) where n < 25
        union all select principal, 'listed but hidden', document from (select * from listed_pair except select * from derived_pair)
        union all select principal, 'admitted but not listed', document from (select * from derived_pair except select * from listed_pair)
        union all select distinct e.case_id, 'principal without visibility labels', e.principal from eval_case e where e.principal not in (select principal from listed_pair)"""
    ),
    "e16_authorization_negatives": evaluated(
        """select e.principal, count(distinct case_id) as cases, count(*) filter (p.tenant_id <> v.tenant_id) as tenant, count(*) filter (v.classification_rank > p.clearance_rank) as clearance,
            count(*) filter (len(v.allowed_departments) > 0 and not coalesce(list_contains(v.allowed_departments, p.department), false)) as department,
            count(*) filter (len(v.required_projects) > 0 and not list_has_any(v.required_projects, p.projects)) as project
        from (select case_id, principal, unnest(unauthorized_documents) as key from eval_case) e join principal p on p.subject = e.principal join current_version v on v.key = e.key group by e.principal"""
    ),
    "e17_reviewed_filter": evaluated("select case_id, strategy, split from record where reviewed"),
    "e18_latency_p50_p95": sql(
        """select strategy, max(latency_ms) filter (n = least(total - 1, floor(total * 0.5)) + 1) as p50_ms, max(latency_ms) filter (n = least(total - 1, floor(total * 0.95)) + 1) as p95_ms, max(total) as n
        from (select strategy, latency_ms, row_number() over (partition by strategy order by latency_ms) as n, count(*) over (partition by strategy) as total from load_request) group by strategy""",
        load_request=loadrows.REQUEST_SQL,
    ),
    "e19_dataset_digest": evaluated(
        """select count(*) as rows, sha256(count(*) || ':' || sum(('0x' || substr(sha256(concat_ws(chr(31), case_id, split, query, principal, must_abstain::VARCHAR)), 1, 15))::BIGINT)) as digest from eval_case"""
    ),
    "e20_manifest_differences": sql(
        """select key, field, a.value as before, b.value as after from version_field a join version_field b using (key, field)
        where a.version_no = 1 and b.version_no = (select max(x.version_no) from version x where x.key = a.key) and a.value <> b.value""",
        version_field="""
            unpivot (select key, version_no, classification, format, coalesce(strftime(valid_from, '%Y-%m-%d'), 'none') as valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), 'none') as valid_to,
                array_to_string(allowed_departments, ',') as "labels.departments", md5(content) as content from version)
            on classification, format, valid_from, valid_to, "labels.departments", content into name field value value""",
    ),
    "e21_dataset_profile": evaluated(
        """select 'split' as dimension, split as value, count(*) as cases from eval_case group by all union all select 'principal', principal, count(*) from eval_case group by all
        union all select 'overlap', coalesce(band, 'none'), count(*) from eval_case left join band using (case_id) group by all
        union all select 'reviewed', case when doc_id in (select doc_id from labels) then 'yes' else 'no' end, count(*) from eval_case group by all
        union all select 'negative', case when len(unauthorized_documents) > 0 then 'yes' else 'no' end, count(*) from eval_case group by all
        union all select 'tag', t, count(*) from (select unnest(tags) as t from eval_case) group by all"""
    ),
    "e22_select_attempt": sql(
        """select case_id as "case", strategy, count(*) as attempts, min(n) filter (stops) as selected, min(n) filter (stops) is null as invalid, coalesce(min(n) filter (stops), count(*)) - 1 as repeats
        from (select *, row_number() over (partition by case_id, strategy order by ts, event_id) as n, violations > 0 or reason is null as stops from load_request qualify n <= 3) group by all""",
        load_request=loadrows.REQUEST_SQL,
    ),
    "e23_stratified_holdout": evaluated(
        f"""select case_id, principal, must_abstain, negative from (select *, row_number() over w as n, count(*) over (partition by principal, must_abstain, negative) as total
            from (select *, len(unauthorized_documents) > 0 as negative from eval_case) window w as (partition by principal, must_abstain, negative order by {h('holdout', 'case_id')}, case_id))
        where n <= floor(total / 5 + 0.5)"""
    ),
}
