"""Versioned ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog.retrieval import longs
from permlens.catalog.sql import h, normalize, sql
from permlens.functions import text as T
from permlens.functions.hashing import draw
from permlens.operators import versions as V
from permlens.plans.corpus import Corpus

KEY = "key"


def base(c: Corpus) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    sets = {n: F.coalesce(F.col(n), none) for n in V.SETS}
    return c.manifests.withColumns(
        sets | {"classification": F.coalesce("classification", F.lit("public")), "source_uri": F.when(draw("link", KEY) % 2 == 0, "").otherwise(F.lit(None))}
    )


def submissions(c: Corpus) -> DataFrame:
    """Up to four submissions of every document, in jobs of 500: as stored, the same again, other labels, revised content."""

    def build() -> DataFrame:
        first = base(c).select("doc_id", "tenant_id", "key", "content", "format", *V.METADATA)
        again = first.where(draw("sub2", KEY) % 2 == 0).withColumn("allowed_departments", F.concat("allowed_departments", "allowed_departments"))
        relabelled = first.where(draw("sub3", KEY) % 3 == 0).withColumn("classification", F.lit("internal"))
        revised = first.where(draw("sub4", KEY) % 4 == 0).withColumn("content", F.concat("content", F.lit("\n\nRevised.")))
        parts = [df.withColumn("seq", F.lit(i)) for i, df in enumerate((first, again, relabelled, revised), 1)]
        everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        job = F.format_string("job-%d-%05d", "seq", F.floor(F.col("doc_id") / 500))
        return everything.select(
            "tenant_id", "key", job.alias("job_id"), (F.col("doc_id") % 500).alias("ordinal"), V.content_sha(F.col("content")).alias("sha"), "format", V.metadata().alias("metadata")
        )

    return c._once("submission", build)


def state(c: Corpus) -> DataFrame:
    """What is stored before the jobs: three in four documents, some with other content, some deleted or disabled."""

    def build() -> DataFrame:
        stored = base(c).where(draw("state", KEY) % 4 > 0)
        content = F.when(draw("same", KEY) % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("\n\nOlder.")))
        active = draw("n0", KEY) % 3 + 1
        s = draw("st", KEY) % 10
        return stored.select(
            "tenant_id", "key", "format", V.content_sha(content).alias("sha"), V.metadata().alias("metadata"),
            F.when(s == 0, "deleted").when(s == 1, "disabled").otherwise("active").alias("status"),
            active.alias("active_version_no"), (active + draw("n1", KEY) % 2).alias("last_version_no"), active.alias("content_version_no"),
        )

    return c._once("state", build)


def planned(c: Corpus) -> DataFrame:
    return c._once("planned", lambda: V.plan_versions(submissions(c), state(c)))


def v5(c: Corpus) -> DataFrame:
    """Stored metadata against the same metadata as it may arrive: repeated and reordered labels, a blank link, another title."""
    rows = base(c)
    arrives = (
        rows.withColumn("allowed_departments", F.concat("allowed_departments", "allowed_departments"))
        .withColumn("source_uri", F.when(F.col("source_uri").isNull(), F.lit("  ")))
        .withColumn("title", F.when(draw("retitle", KEY) % 10 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
        .select("key", V.metadata().alias("arrives"))
    )
    return rows.select("key", V.metadata().alias("stored")).join(arrives, "key").select("key", F.col("stored").eqNullSafe(F.col("arrives")).alias("equal"))


def v6(c: Corpus) -> DataFrame:
    actions = F.create_map(*[F.lit(x) for x in ("click", "active", "view", "disabled", "purchase", "deleted", "signup", "ingest")])
    events = c.given("events").select(
        F.when(draw("side", F.col("event_id").cast("string")) % 5 == 0, "external").otherwise("northstar").alias("tenant_id"),  # one key, two documents
        F.concat(F.lit("doc-"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("key"),
        F.struct("ts", "event_id").alias("at"),
        F.try_element_at(actions, F.col("event_type")).alias("action"),
    )
    return V.final_status(events.where(F.col("action").isNotNull()))


def contents(c: Corpus) -> DataFrame:
    """Every content that a version or a submission has, by its digest."""
    old = c.versions.select("tenant_id", "key", F.col("version_no").cast("int").alias("version_no"), "format", "content")
    new = base(c).where(draw("sub4", KEY) % 4 == 0).select("tenant_id", "key", F.lit(0).alias("version_no"), "format", F.concat("content", F.lit("\n\nRevised.")).alias("content"))
    return old.unionByName(new).withColumn("sha", V.content_sha(F.col("content")))


def chunk_counts(c: Corpus) -> DataFrame:
    return c._once("content_chunk", lambda: V.content_chunks(contents(c)).groupBy("sha", "format").agg(F.count(F.lit(1)).alias("chunks")))


def v7(c: Corpus) -> DataFrame:
    known = c.versions.select("tenant_id", "key", "version_no", "format", V.content_sha(F.col("content")).alias("sha"))
    gone = V.unreachable_versions(known, c.current)
    return longs(V.unreachable_chunks(gone, chunk_counts(c)).select("key", "version_no", "chunks"), "version_no")


def v8(c: Corpus) -> DataFrame:
    d, other = draw("bad", KEY) % 20, draw("worse", KEY) % 20  # none, one or two faults
    spoil = lambda at, name, value: F.when((d == at) | (other == at), value).otherwise(F.col(name)).alias(name)
    rows = base(c).select(
        F.col("key").alias("document"),
        spoil(0, "key", F.upper("key")), spoil(1, "title", F.lit("  ")), spoil(2, "source_uri", F.repeat(F.lit("x"), 2001)), spoil(3, "format", F.lit("pdf")),
        spoil(4, "classification", F.lit("Secret")), spoil(5, "allowed_departments", F.array(F.lit(" "))), spoil(6, "required_projects", F.array(F.lit("a\tb"))),
        spoil(7, "applies_to_regions", F.array(F.repeat(F.lit("E"), 51))), spoil(8, "valid_from", F.to_timestamp(F.lit("2030-01-01 00:00:00"))),
        spoil(8, "valid_to", F.to_timestamp(F.lit("2029-01-01 00:00:00"))), F.when((d == 9) | (other == 9), F.lit(" \n ")).when((d == 10) | (other == 10), F.concat("content", F.lit(T.MARK))).otherwise(F.col("content")).alias("content"),
    )
    return V.submission_errors(rows).select("document", F.array_join("errors", ",").alias("errors"))


def v8_jobs(c: Corpus) -> DataFrame:
    """Jobs over the size limit, taking all documents of one tenant and status as one job."""
    return V.oversized_jobs(c.manifests.select(F.concat_ws("-", "tenant_id", "status").alias("job_id")))


def v9(c: Corpus) -> DataFrame:
    return V.job_counters(planned(c), chunk_counts(c))


def v10(c: Corpus) -> DataFrame:
    loaded = c.manifests.where(draw("loaded", KEY) % 4 == 0)
    rows = V.replay_rounds(c.versions, loaded)
    return longs(rows.select("key", "version_no", "round", "batch"), "version_no", "round", "batch")


ANCHOR = dict(zip(V.PROFILE_FIELDS, ("hashing", "1", "384", "query: ", "passage: ", "on", "4", "180", "30", "384", "2000", "200", "words"), strict=True))
# Fields that drawn versions were made with differently: the draw, the field, its other value.
OTHER_PROFILES = [(0, "embedding_model", "other"), (1, "chunker_release", "3"), (2, "embedding_revision", "0"), (3, "passage_prefix", ""), (4, "chunk_overlap_words", "20"), (4, "chunk_tokenizer", "bytes")]


def profiles(c: Corpus) -> DataFrame:
    d = draw("profile", KEY) % 50

    def value(field: str):
        out = F.lit(ANCHOR[field])
        for n, name, other in OTHER_PROFILES:
            out = F.when(d == n, other).otherwise(out) if name == field else out
        return out.alias(field)

    return c.active.select(*[value(f) for f in ANCHOR])


def v12(c: Corpus) -> DataFrame:
    release = F.when(draw("profile", KEY) % 50 == 1, "3").otherwise("4")
    return V.chunker_releases(c.active.select(F.concat_ws("/", "format", release).alias("chunker_version")))


def v13(c: Corpus) -> DataFrame:
    labelled = c.current.select("tenant_id", "key", (F.col("version_no") - (draw("behind", KEY) % 30 == 0).cast("int")).alias("labelled_version_no"))
    ahead = c.chunks.join(labelled, ["tenant_id", "key"]).where(F.col("version_no") > F.col("labelled_version_no"))
    return longs(ahead.select("key", "version_no", "ordinal"), "version_no", "ordinal")


def v14(c: Corpus) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "attempt_failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "lease_lost").otherwise("heartbeat")
    events = c.given("events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), kind.alias("kind"))
    return V.job_states(events)


def outcome(c: Corpus) -> DataFrame:
    return planned(c).select("key", "job_id", F.col("ordinal").cast("bigint").alias("ordinal"), "outcome")


QUERIES = {
    "v1_classify_submissions": outcome,
    "v2_assign_version_numbers": lambda c: planned(c).select("key", "job_id", "version_no"),
    "v3_apply_versions": lambda c: V.apply_versions(state(c), planned(c)).drop("content_version_no"),
    "v4_relabel_keeps_chunks": lambda c: planned(c).where("version_no is not null").select("key", "version_no", "content_version_no"),
    "v5_metadata_equality": v5,
    "v6_change_status": v6,
    "v7_purge_unreachable": v7,
    "v8_validate_submissions": v8,
    "v8_validate_submissions_jobs": v8_jobs,
    "v9_job_counters": v9,
    "v10_replay_rounds": v10,
    "v11_profile_consistency": lambda c: V.profile_report(profiles(c), ANCHOR),
    "v12_mixed_chunker_check": v12,
    "v13_version_ahead_check": v13,
    "v14_cascade_job_state": v14,
}

_META = "to_json({'t': title, 'c': coalesce(classification, 'public'), 'd': list_sort(list_distinct(coalesce(allowed_departments, []::VARCHAR[]))), 'p': list_sort(coalesce(required_projects, []::VARCHAR[])), 'r': list_sort(coalesce(applies_to_regions, []::VARCHAR[])), 'f': valid_from, 'u': valid_to})::VARCHAR"
_RELABELLED = _META.replace("coalesce(classification, 'public')", "'internal'")
PLAN_SQL = {
    "submitted": f"""
        select tenant_id, key, format, 'job-' || seq || '-' || lpad((doc_id // 500)::VARCHAR, 5, '0') as job_id, doc_id % 500 as ordinal, seq,
            sha256(case when seq = 4 then {normalize("(content || chr(10) || chr(10) || 'Revised.')")} else {normalize('content')} end) as sha, case when seq = 3 then {_RELABELLED} else {_META} end as meta
        from manifest, (select unnest([1, 2, 3, 4]) as seq)
        where seq = 1 or (seq = 2 and {h('sub2', 'key')} % 2 = 0) or (seq = 3 and {h('sub3', 'key')} % 3 = 0) or (seq = 4 and {h('sub4', 'key')} % 4 = 0)""",
    "stored": f"""
        select tenant_id, key, format, sha256(case when {h('same', 'key')} % 2 = 0 then {normalize('content')} else {normalize("(content || chr(10) || chr(10) || 'Older.')")} end) as sha, {_META} as meta,
            case when {h('st', 'key')} % 10 = 0 then 'deleted' when {h('st', 'key')} % 10 = 1 then 'disabled' else 'active' end as status,
            {h('n0', 'key')} % 3 + 1 as active_version_no, {h('n0', 'key')} % 3 + 1 + {h('n1', 'key')} % 2 as last_version_no
        from manifest where {h('state', 'key')} % 4 > 0""",
    "planning": """
        select n.key, n.tenant_id, n.format, 0 as seq, s.sha, s.meta, s.status is not null and s.status <> 'deleted' as has_content, coalesce(s.last_version_no, 0) as last_no, s.active_version_no as owner,
            null::VARCHAR as outcome, null::VARCHAR as job_id, null::BIGINT as ordinal
        from (select distinct key, tenant_id, format from submitted) n left join stored s using (key)
        union all
        select p.key, p.tenant_id, p.format, n.seq, n.sha, n.meta, true, case when o <> 'unchanged' then p.last_no + 1 else p.last_no end, case when o in ('created', 'updated') then p.last_no + 1 else p.owner end, o, n.job_id, n.ordinal
        from planning p join submitted n on n.key = p.key and n.seq = (select min(x.seq) from submitted x where x.key = p.key and x.seq > p.seq),
            lateral (select case when not p.has_content then 'created' when p.sha = n.sha and p.meta = n.meta then 'unchanged' when p.sha = n.sha then 'relabelled' else 'updated' end as o)""",
    "planned_row": "select * from planning where seq > 0",
}
_FAULTS = [("key", 0), ("title", 1), ("source_uri", 2), ("content", 9, 10), ("format", 3), ("classification", 4), ("allowed_departments", 5), ("required_projects", 6), ("applies_to_regions", 7), ("validity", 8)]
_DOC = "'doc-' || lpad(user_id::VARCHAR, 7, '0')"
CONTENT_SQL = {  # the chunks of contents: each is a document of its own to the shared definitions
    "any_content": f"""
        select content, format from version union select content || chr(10) || chr(10) || 'Revised.', format from manifest where {h('sub4', 'key')} % 4 = 0""",
    "current_version": f"select '' as tenant_id, sha256({normalize('content')}) || ':' || format as key, 1 as version_no, format, any_value(content) as content from any_content group by 2, format",
    "counted_content": "select split_part(key, ':', 1) as sha, split_part(key, ':', 2) as format, count(*) as n from chunk group by all",
}


def _profile_value(field: str) -> str:
    cases = "".join(f"when d = {n} then '{other}' " for n, name, other in OTHER_PROFILES if name == field)
    return f"case {cases}else '{ANCHOR[field]}' end as {field}" if cases else f"'{ANCHOR[field]}' as {field}"


SQL = {
    "v1_classify_submissions": sql("select key, job_id, ordinal::BIGINT as ordinal, outcome from planned_row", **PLAN_SQL),
    "v2_assign_version_numbers": sql("select key, job_id, case when outcome <> 'unchanged' then last_no end::BIGINT as version_no from planned_row", **PLAN_SQL),
    "v3_apply_versions": sql(
        """select coalesce(s.tenant_id, n.tenant_id) as tenant_id, key, case when s.status is null or (n.v is not null and s.status = 'deleted') then 'active' else s.status end as status,
            coalesce(n.v, s.active_version_no)::BIGINT as active_version_no, greatest(n.v, s.last_version_no)::BIGINT as last_version_no
        from stored s full join (select tenant_id, key, max(last_no) as v from planned_row where outcome <> 'unchanged' group by all) n using (key)""",
        **PLAN_SQL,
    ),
    "v4_relabel_keeps_chunks": sql("select key, last_no::BIGINT as version_no, owner::BIGINT as content_version_no from planned_row where outcome <> 'unchanged'", **PLAN_SQL),
    "v5_metadata_equality": sql(f"select key, {h('retitle', 'key')} % 10 > 0 as equal from manifest"),
    "v6_change_status": f"""
        select tenant_id, key, list_reduce(list_concat(['active'], list(action order by ts, event_id)), lambda s, a: case when a = 'ingest' then case when s = 'deleted' then 'active' else s end
            when s = 'deleted' then s else a end) as status
        from (select case when {h('side', 'event_id')} % 5 = 0 then 'external' else 'northstar' end as tenant_id, {_DOC} as key, ts, event_id, case event_type when 'click' then 'active' when 'view' then 'disabled' when 'purchase' then 'deleted' when 'signup' then 'ingest' end as action from events)
        where action is not null group by tenant_id, key""",
    "v7_purge_unreachable": sql(
        f"""select v.key, v.version_no::BIGINT as version_no, coalesce(n, 0) as chunks from version v left join counted_content k on k.sha = sha256({normalize('v.content')}) and k.format = v.format
        where v.status = 'deleted' or v.version_no <> (select max(x.version_no) from version x where x.key = v.key)""",
        **CONTENT_SQL,
    ),
    "v8_validate_submissions": sql(
        f"""select key as document, concat_ws(',', {", ".join(f"case when {' or '.join(f'd = {n} or e = {n}' for n in at)} then '{name}' end" for name, *at in _FAULTS)}) as errors
        from (select *, {h('bad', 'key')} % 20 as d, {h('worse', 'key')} % 20 as e from manifest)"""
    ),
    "v8_validate_submissions_jobs": sql(
        "select tenant_id || '-' || status as job_id, count(*) as documents from manifest group by all having count(*) > 500"
    ),
    "v9_job_counters": sql(
        """select job_id, count(*) filter (outcome = 'created') as created, count(*) filter (outcome in ('updated', 'relabelled')) as updated, count(*) filter (outcome = 'unchanged') as unchanged,
            count(*) as processed, coalesce(sum(n) filter (outcome in ('created', 'updated')), 0)::BIGINT as chunks
        from planned_row left join counted_content using (sha, format) group by job_id""",
        **(PLAN_SQL | CONTENT_SQL),
    ),
    "v10_replay_rounds": sql(
        f"""select key, version_no::BIGINT as version_no, round::BIGINT as round, ((row_number() over (partition by round order by tenant_id, key) - 1) // 200 + 1)::BIGINT as batch
        from (select *, max(case when loaded then 1 else n end) over () - n + version_no as round
            from (select tenant_id, key, version_no, max(version_no) over (partition by tenant_id, key) as n, {h('loaded', 'key')} % 4 = 0 as loaded from version) where not loaded or version_no = n)"""
    ),
    "v11_profile_consistency": sql(
        f"""select sha256(concat_ws('|', {", ".join(ANCHOR)})) as profile_id, count(*) as versions,
            concat_ws(',', {", ".join(f"case when {f} <> '{v}' then '{f}' end" for f, v in ANCHOR.items())}) as differs, count(*) over () > 1 as mixed
        from (select {", ".join(_profile_value(f) for f in ANCHOR)} from (select {h('profile', 'key')} % 50 as d from active_version)) group by all having true"""
    ),
    "v12_mixed_chunker_check": sql(
        f"select case when {h('profile', 'key')} % 50 = 1 then '3' else '4' end as release, count(*) as documents, count(*) over () > 1 as mixed from active_version group by all"
    ),
    "v13_version_ahead_check": sql(f"select key, version_no::BIGINT as version_no, ordinal from chunk where {h('behind', 'key')} % 30 = 0"),
    "v14_cascade_job_state": """
        select user_id as job_id, r.state, r.failures::BIGINT as failures, case when r.state = 'queued' then 5 * pow(2, least(r.failures - 1, 10)) end::BIGINT as retry_seconds from (
            select user_id, list_reduce(list_concat([{'state': 'running', 'failures': 0}], list({'state': event_type, 'failures': 0} order by ts, event_id)),
                lambda s, e: case when s.state in ('succeeded', 'failed') then s when e.state = 'purchase' then {'state': 'succeeded', 'failures': s.failures}
                    when e.state = 'error' then {'state': case when s.failures + 1 >= 5 then 'failed' else 'queued' end, 'failures': s.failures + 1}
                    when e.state = 'signup' then {'state': case when s.failures + 1 >= 5 then 'failed' else 'running' end, 'failures': s.failures + 1}
                    else {'state': 'running', 'failures': s.failures} end) as r
            from events group by user_id)""",
}
