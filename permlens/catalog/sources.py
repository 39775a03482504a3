"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog import loadrows
from permlens.catalog.retrieval import longs
from permlens.catalog.sql import sql
from permlens.plans.corpus import Corpus
from permlens.session import work_folder
from permlens.sources import files


EXPORT_FILE_BYTES = 100_000  # so that even small tables fill several files


def folder(c: Corpus, name: str) -> str:
    return f"{work_folder(c.spark)}/{name}-{uuid.uuid4().hex}"


def joined(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


def s1(c: Corpus) -> DataFrame:
    day = lambda n: F.date_format(n, "yyyy-MM-dd").alias(n)
    rows = c.versions.select(
        "tenant_id", "key", "version_no", "title", "format", "classification", joined("allowed_departments"), joined("required_projects"),
        joined("applies_to_regions"), day("valid_from"), day("valid_to"), F.md5("content").alias("content"),
    )
    return longs(rows, "version_no")


def s2(c: Corpus) -> DataFrame:
    path = F.concat("tenant_id", F.lit("/"), "key", F.when(F.col("format") == "markdown", ".md").otherwise(".txt"))
    place = folder(c, "corpus-files")
    folders = c.manifests.count() // files.FOLDER_FILES + 1  # of a bounded number of files, so that no listing holds them all
    part = F.pmod(F.xxhash64("key"), F.lit(folders)).cast("string")
    files.write_texts(c.manifests.select(F.concat_ws("/", part, path).alias("file"), "content"), place)
    return files.corpus_files(c.spark, place, levels=2).select("file", "format", F.md5("content").alias("content"))


def s3(c: Corpus) -> DataFrame:
    path = folder(c, "cases")
    c.cases.drop("doc_id", "quote").write.option("ignoreNullFields", False).json(path)
    rows = files.typed_json(c.spark, path, files.CASE_SCHEMA)
    return longs(
        rows.select(
            "case_id", "split", "principal", F.md5("query").alias("query"), F.size("evidence").alias("evidence"), "must_abstain", "region",
            F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), F.array_join("tags", ",").alias("tags"),
            F.array_join("unauthorized_documents", ",").alias("unauthorized"), F.array_join("out_of_scope_documents", ",").alias("out_of_scope"),
        ),
        "evidence",
    )


def s4(c: Corpus) -> DataFrame:
    """Every principal with the readable documents and asked cases of the tables; administrators are flagged and ask nothing."""
    asked = c.cases.groupBy("principal").agg(F.count(F.lit(1)).alias("cases"))
    return c.all_principals.join(asked, F.col("subject") == F.col("principal"), "left").select(
        "subject", "tenant_id", "department", F.array_join("projects", ",").alias("projects"), "clearance", "region",
        (F.col("role") == "admin").alias("admin"), F.coalesce("cases", F.lit(0)).alias("cases"),
    )


def s5(c: Corpus) -> DataFrame:
    path = folder(c, "requests")
    loadrows.requests(c).drop("event_id", "code", "ts").write.option("ignoreNullFields", False).json(path)
    rows = files.load_requests(c.spark, path)
    return rows.groupBy("principal", "strategy", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.size(F.coalesce("results", F.array()))).alias("results"), F.round(F.sum("latency_ms"), 3).alias("latency_ms")
    )


def s6(c: Corpus) -> DataFrame:
    path = folder(c, "stages")
    rows = loadrows.requests(c)
    reading = F.round(F.max("latency_ms"), 1)
    per_strategy = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("requests"), reading.alias("sparse_p95_ms"), F.lit("").alias("rerank_p95_ms"))
    per_strategy.write.option("header", True).csv(path)
    return files.stage_readings(c.spark, path)


def s6_audit(c: Corpus) -> DataFrame:
    """Readings without a header, one of them blank."""
    path = folder(c, "audit-readings")
    rows = c.given("events").groupBy(F.col("event_type").alias("label")).agg(F.sum(F.length("props")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    rows.select("label", F.when(F.col("label") == "error", "").otherwise(F.col("bytes").cast("string")).alias("bytes"), "rows").write.csv(path)
    return files.audit_readings(c.spark, path)


def s7(c: Corpus) -> DataFrame:
    path = folder(c, "run")
    files.write_results(c.results.withColumn("run_id", F.concat(F.lit("run-"), "strategy")), path)
    back = c.spark.read.json(path)
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("request_id").alias("requests"))


def s8(c: Corpus) -> DataFrame:
    """Every exported line in the order of files and lines, and whether the lines found are those of the manifest."""
    rows = loadrows.audit(c).where(F.col("occurred_at") < F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    place = folder(c, "audit")
    manifest = files.export_ndjson(rows, ["occurred_at", "event_id"], place, EXPORT_FILE_BYTES)
    lines = files.exported_lines(c.spark, place)
    changed = files.export_differences(manifest, c.spark, place).select("file_no", F.lit(False).alias("kept"))
    return lines.join(changed, "file_no", "left").select("n", F.get_json_object("line", "$.event_id").cast("bigint").alias("event_id"), F.coalesce("kept", F.lit(True)).alias("whole"))


QUERIES = {
    "s1_src_manifest_versions": s1,
    "s2_src_corpus_text": s2,
    "s3_src_cases_jsonl": s3,
    "s4_src_principals": s4,
    "s5_src_load_requests": s5,
    "s6_src_stage_csv": s6,
    "s6_src_stage_csv_audit": s6_audit,
    "s7_sink_results_jsonl": s7,
    "s8_sink_audit_ndjson": s8,
}


def _joined(name: str) -> str:
    return f"array_to_string(list_sort({name}), ',') as {name}"


SQL = {
    "s1_src_manifest_versions": sql(
        f"""select tenant_id, key, version_no::BIGINT as version_no, title, format, classification, {_joined('allowed_departments')}, {_joined('required_projects')}, {_joined('applies_to_regions')},
            strftime(valid_from, '%Y-%m-%d') as valid_from, strftime(valid_to, '%Y-%m-%d') as valid_to, md5(content) as content from version"""
    ),
    "s2_src_corpus_text": sql(
        "select tenant_id || '/' || key || case when format = 'markdown' then '.md' else '.txt' end as file, format, md5(content) as content from manifest"
    ),
    "s3_src_cases_jsonl": sql(
        """select case_id, split, principal, md5(query) as query, answerable::BIGINT as evidence, must_abstain, region, strftime(as_of, '%Y-%m-%d %H:%M:%S') as as_of,
            array_to_string(tags, ',') as tags, array_to_string(unauthorized_documents, ',') as unauthorized, array_to_string(out_of_scope_documents, ',') as out_of_scope from eval_case"""
    ),
    "s4_src_principals": sql(
        """select subject, tenant_id, department, array_to_string(projects, ',') as projects, clearance, region, role = 'admin' as admin, coalesce(cases, 0) as cases
        from principal_all left join (select principal as subject, count(*) as cases from eval_case group by all) using (subject)"""
    ),
    "s5_src_load_requests": sql(
        "select principal, strategy, status, count(*) as requests, count(*) filter (status = 200) as results, round(sum(latency_ms), 3) as latency_ms from load_request group by all",
        load_request=loadrows.REQUEST_SQL,
    ),
    "s6_src_stage_csv": sql(
        "select strategy, count(*) as requests, round(max(latency_ms), 1) as sparse_p95_ms, null::DOUBLE as rerank_p95_ms from load_request group by all",
        load_request=loadrows.REQUEST_SQL,
    ),
    "s6_src_stage_csv_audit": "select event_type as label, case when event_type <> 'error' then sum(len(props)) end::BIGINT as bytes, count(*) as rows from events group by event_type",
    "s7_sink_results_jsonl": sql("select 'run-' || strategy as run_id, count(*) as rows, count(distinct request_id) as requests from result group by all"),
    "s8_sink_audit_ndjson": "select row_number() over (order by ts, event_id) as n, event_id, true as whole from events where ts < timestamp '2024-01-20'",
}
