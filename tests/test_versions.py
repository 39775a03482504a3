import random

from pyspark.sql import functions as F

from permlens.operators import versions as V

EMPTY = "cast(array() as array<string>)"
STATE = (
    "tenant_id string, key string, format string, sha string, metadata string, status string, active_version_no bigint, last_version_no bigint, "
    "content_version_no bigint"
)
SUBMISSION = "tenant_id string, key string, job_id string, ordinal bigint, sha string, format string, metadata string"


def brute_plan(submissions, stored):
    out = {}
    for key in {s[1] for s in submissions}:
        st = stored.get(key)
        before = (st["sha"], st["format"], st["metadata"]) if st and st["status"] != "deleted" else None
        last, owner = (st["last"], st["owner"]) if st else (0, None)
        for s in sorted((x for x in submissions if x[1] == key), key=lambda x: (x[2], x[3])):
            now = (s[4], s[5], s[6])
            outcome = "created" if before is None else "unchanged" if before == now else "relabelled" if before[:2] == now[:2] else "updated"
            if outcome != "unchanged":
                last += 1
                owner = last if outcome != "relabelled" else owner
            out[(key, s[2], s[3])] = (outcome, last if outcome != "unchanged" else None, owner)
            before = now
    return out


def test_one_hot_document_equals_brute_force(spark):
    rng = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    submissions = [("t", rng.choice(keys), f"j{i // 20:03d}", i % 20, f"s{rng.randint(0, 2)}", "text", f"m{rng.randint(0, 1)}") for i in range(400)]
    stored = {
        "hot": dict(sha="s1", format="text", metadata="m0", status="active", last=4, owner=3),
        "a": dict(sha="s0", format="text", metadata="m0", status="deleted", last=9, owner=9),
    }
    state = spark.createDataFrame([("t", k, s["format"], s["sha"], s["metadata"], s["status"], s["owner"], s["last"], s["owner"]) for k, s in stored.items()], STATE)
    got = {
        (r.key, r.job_id, r.ordinal): (r.outcome, r.version_no, r.content_version_no)
        for r in V.plan_versions(spark.createDataFrame(submissions, SUBMISSION).repartition(3), state).collect()
    }
    assert got == brute_plan(submissions, stored)


def test_state_after_a_batch(spark):
    state = spark.createDataFrame(
        [("t", "gone", "text", "s", "m", "deleted", 2, 2, 2), ("t", "off", "text", "s", "m", "disabled", 1, 3, 1), ("t", "same", "text", "s", "m", "active", 1, 1, 1)], STATE
    )
    batch = spark.createDataFrame(
        [("t", "gone", "j1", 0, "s", "text", "m"), ("t", "off", "j1", 1, "s2", "text", "m"), ("t", "same", "j1", 2, "s", "text", "m"), ("t", "new", "j1", 3, "s", "text", "m")], SUBMISSION
    )
    planned = V.plan_versions(batch, state)
    assert {r.key: r.outcome for r in planned.collect()} == {"gone": "created", "off": "updated", "same": "unchanged", "new": "created"}
    got = {r.key: (r.status, r.active_version_no, r.last_version_no) for r in V.next_state(state, planned).collect()}
    assert got == {"gone": ("active", 3, 3), "off": ("disabled", 4, 4), "same": ("active", 1, 1), "new": ("active", 1, 1)}


def test_status_events_equal_brute_force(spark):
    rng = random.Random(9)
    events = [(rng.choice(["hot"] * 5 + ["a", "b", "c", "d"]), i, rng.choice(["active", "disabled", "deleted", "ingest"])) for i in range(500)]

    def fold(key):
        s = "active"
        for k, _, a in events:
            if k == key:
                s = ("active" if s == "deleted" else s) if a == "ingest" else s if s == "deleted" else a
        return s

    for n in (17, 60, 500):
        events = events[:n] if n < 500 else events
        both = [("t1", *e) for e in events] + [("t2", "hot", 10**6, "deleted"), ("t2", "a", -1, "disabled")]  # the same keys in another tenant
        got = {(r.tenant_id, r.key): r.status for r in V.final_status(spark.createDataFrame(both, "tenant_id string, key string, at int, action string")).collect()}
        assert got == {("t1", k): fold(k) for t, k in got if t == "t1"} | {("t2", "hot"): "deleted", ("t2", "a"): "disabled"}


def test_job_states_equal_brute_force(spark):
    rng = random.Random(2)
    events = [(rng.choice([1] * 4 + list(range(2, 40))), i, rng.choice(["attempt_failed", "lease_lost", "heartbeat", "heartbeat", "succeeded" if i % 9 == 0 else "heartbeat"])) for i in range(400)]

    def fold(job):
        state, failures = "running", 0
        for j, _, kind in events:
            if j != job or state in ("succeeded", "failed"):
                continue
            if kind == "succeeded":
                state = "succeeded"
            elif kind == "attempt_failed":
                failures += 1
                state = "failed" if failures >= 5 else "queued"
            elif kind == "lease_lost":
                failures += 1
                state = "failed" if failures >= 5 else "running"
            else:
                state = "running"
        return state, failures, 5 * 2 ** min(failures - 1, 10) if state == "queued" else None

    got = {r.job_id: (r.state, r.failures, r.retry_seconds) for r in V.job_states(spark.createDataFrame(events, "job_id int, at int, kind string")).collect()}
    assert got == {j: fold(j) for j in got}


def test_submission_errors(spark):
    base = spark.sql(f"""select 'doc-1' as key, 'T' as title, 'u' as source_uri, 'x' as content, 'text' as format, 'public' as classification, {EMPTY} as allowed_departments,
        {EMPTY} as required_projects, {EMPTY} as applies_to_regions, cast(null as timestamp) as valid_from, cast(null as timestamp) as valid_to""")
    errors = lambda df: V.submission_errors(df).first().errors
    assert errors(base) == []
    assert errors(base.withColumn("key", F.lit("Doc 1")).withColumn("content", F.lit(" "))) == ["key", "content"]
    assert errors(base.withColumn("applies_to_regions", F.array(F.lit("x" * 51)))) == ["applies_to_regions"]
    assert errors(base.withColumn("required_projects", F.array_repeat(F.lit("p"), 51))) == ["required_projects"]


def test_metadata_compares_labels_as_sets(spark):
    make = lambda d, link: spark.sql(f"""select 'T' as title, {link} as source_uri, 'public' as classification, array({d}) as allowed_departments, {EMPTY} as required_projects,
        {EMPTY} as applies_to_regions, cast(null as timestamp) as valid_from, cast(null as timestamp) as valid_to""").select(V.metadata().alias("m")).first().m  # noqa: E731
    assert make("'b','a','b'", "' '") == make("'a','b'", "null")
    assert make("'b'", "'u'") != make("'b'", "null")


def test_tables_of_many_contents_are_not_broadcast(spark):
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()

    def tables(n):
        sha = F.sha2(F.col("id").cast("string"), 256).alias("sha")
        counts = spark.range(n).select(sha, F.lit("text").alias("format"), F.lit(2).cast("bigint").alias("chunks"))
        planned = spark.range(n).select(sha, F.lit("text").alias("format"), (F.col("id") % 3).cast("string").alias("job_id"), F.lit("created").alias("outcome"))
        contents = spark.range(n).select(
            F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("key"), F.lit(1).alias("version_no"), sha, F.lit("text").alias("format"), F.lit("one two").alias("content")
        )
        return planned, counts, contents

    planned, counts, contents = tables(100_500)
    got = V.job_counters(planned, counts)
    assert not hinted(got) and not hinted(V.content_chunks(contents))
    assert sum(r.chunks for r in got.collect()) == 2 * 100_500
    planned, counts, contents = tables(30)
    assert hinted(V.job_counters(planned, counts)) and hinted(V.content_chunks(contents))
    assert V.content_chunks(contents).count() == 30
