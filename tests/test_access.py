from pyspark.sql import functions as F

from permlens.functions import labels as L
from permlens.operators import access

P = "subject string, tenant_id string, department string, projects array<string>, clearance string, role string"
V = (
    "tenant_id string, key string, version_no int, classification string, allowed_departments array<string>, required_projects array<string>"
)


def tables(spark):
    principals = spark.createDataFrame(
        [
            ("ann", "t1", "sales", ["a"], "internal", "query"),
            ("ben", "t1", None, [], None, "query"),
            ("cat", "t1", "sales", ["a", "b"], "RESTRICTED", "query"),
            ("dan", "t2", "ops", [], "restricted", "query"),
            ("eve", "t1", "o'ps,{}\\", ["x\"y"], "restricted", "query"),
        ],
        P,
    ).withColumn("clearance_rank", L.clearance_rank(F.col("clearance")))
    versions = spark.createDataFrame(
        [
            ("t1", "open", 1, "public", [], []),
            ("t1", "internal", 1, "internal", [], []),
            ("t1", "sales", 1, "public", ["sales", "hr"], []),
            ("t1", "either", 1, "public", [], ["b", "c"]),
            ("t1", "both", 1, "internal", ["sales"], ["a"]),
            ("t1", "hostile", 1, "restricted", ["o'ps,{}\\"], ["x\"y"]),
            ("t2", "other", 1, "public", [], []),
        ],
        V,
    ).withColumn("classification_rank", L.clearance_rank(F.col("classification")))
    return principals, versions


def test_rule_admits_exactly_the_decision_table(spark):
    principals, versions = tables(spark)
    got = {(r.subject, r.key) for r in access.visible_versions(versions, principals).collect()}
    assert got == {
        ("ann", "open"), ("ann", "internal"), ("ann", "sales"), ("ann", "both"),
        ("ben", "open"),
        ("cat", "open"), ("cat", "sales"), ("cat", "either"),
        ("dan", "other"),
        ("eve", "open"), ("eve", "internal"), ("eve", "hostile"),
    }


def test_two_writings_of_the_rule_agree(spark):
    principals, versions = tables(spark)
    first = access.visible_versions(versions, principals).select("subject", "key")
    second = access.visibility_by_tokens(versions, principals).select("subject", "key")
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0


def test_every_project_rule_is_stricter(spark):
    principals, versions = tables(spark)
    rows = {(r.subject, r.key) for r in access.stricter_visibility(principals, versions).collect()}
    assert ("cat", "either") not in rows
    people, documents = principals.collect(), versions.collect()

    def reads(p, d):
        return (
            p.role != "admin" and p.tenant_id == d.tenant_id and d.classification_rank <= p.clearance_rank and (not d.allowed_departments or p.department in d.allowed_departments)
            and set(d.required_projects) <= set(p.projects or [])
        )

    assert rows == {(p.subject, d.key) for p in people for d in documents if reads(p, d)}
    plan = access.stricter_visibility(principals, versions)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_are_compared_by_label_combination(spark):
    principals, versions = tables(spark)
    counts = access.compared_rules(versions.unionByName(versions), principals).first()
    assert (counts.only_rule, counts.only_tokens) == (0, 0) and counts.pairs == 2 * access.visible_versions(versions, principals).count()


def test_scope_bounds_are_half_open_and_no_time_means_no_scope(spark):
    rows = spark.sql("""select * from values
        ('now', timestamp'2026-01-01', timestamp'2026-02-01', array()), ('eu', null, null, array('EU')), ('later', timestamp'2027-01-01', null, array())
        as t(key, valid_from, valid_to, applies_to_regions)""").withColumn("applies_to_regions", F.col("applies_to_regions").cast("array<string>"))

    def keys(as_of, region):
        t = F.lit(as_of).cast("timestamp")
        return {r.key for r in rows.alias("d").where(L.in_scope(t, F.lit(region).cast("string"), "d")).collect()}

    assert keys("2026-01-01 00:00:00", "EU") == {"now", "eu"}
    assert keys("2026-02-01 00:00:00", "EU") == {"eu"}
    assert keys("2026-01-10 00:00:00", "US") == {"now"}
    assert keys("2026-01-10 00:00:00", None) == {"now", "eu"}
    assert keys(None, "US") == {"now", "eu", "later"}


def test_no_nested_loop_and_no_cartesian_product(spark):
    principals, versions = tables(spark)
    plan = access.visible_versions(versions, principals)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_denied_missing_and_foreign_reads_look_the_same(spark):
    principals, versions = tables(spark)
    titled = versions.withColumn("title", F.col("key"))
    reads = spark.createDataFrame([("ben", "open"), ("ben", "internal"), ("ben", "other"), ("ben", "nowhere")], "subject string, key string")
    rows = {r.key: (r.decision, r.title, r.version_no) for r in access.read_decisions(reads, principals, titled).collect()}
    assert rows["open"] == ("allow", "open", 1)
    assert rows["internal"] == rows["other"] == rows["nowhere"] == ("deny", None, None)


def test_pages_and_cursors(spark):
    rows = [("ann", f"d{i}", 1, o) for i in range(5) for o in range(3)]
    chunks = spark.createDataFrame(rows, "subject string, key string, version_no int, ordinal int")
    got = access.listing_pages(chunks, 4).orderBy("key", "ordinal").collect()
    assert [r.page for r in got] == [i // 4 + 1 for i in range(15)]
    assert [r.next_cursor for r in got if r.next_cursor] == ["d1|1|0", "d2|1|1", "d3|1|2"]
    assert access.after_cursor(chunks, "d3", 1, 2).count() == 3


def test_unknown_subjects_are_denied_and_kept(spark):
    principals, versions = tables(spark)
    active = versions.withColumn("title", F.lit("T"))
    reads = spark.createDataFrame([(1, "ann", "both"), (2, "ann", "hostile"), (3, "nobody", "open"), (4, None, "open"), (5, "dan", "open"), (6, "ann", "none")], "n int, subject string, key string")
    got = {r.n: (r.decision, r.title, r.version_no) for r in access.read_decisions(reads, principals, active).collect()}
    assert got == {1: ("allow", "T", 1)} | {n: ("deny", None, None) for n in range(2, 7)}
    requests = spark.createDataFrame([("a", "ann", None, None), ("b", "nobody", None, "EU")], "request_id string, subject string, as_of timestamp, region string")
    rows = access.scoped_requests(requests, principals.withColumn("region", F.lit("US")), F.lit("2026-01-01").cast("timestamp")).orderBy("request_id").collect()
    assert [(r.request_id, r.tenant_id, r.region) for r in rows] == [("a", "t1", "US"), ("b", None, "EU")]


def test_reads_are_judged_without_a_table_of_what_everyone_may_read(spark):
    principals, versions = tables(spark)
    reads = spark.createDataFrame([(1, "ann", "both")], "n int, subject string, key string")
    plan = access.read_decisions(reads, principals, versions.withColumn("title", F.lit("T")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_only_documents_with_several_rows_are_ranked(spark):
    rows = [("t1", "one", 1, "a"), ("t1", "two", 1, "b"), ("t1", "two", 2, "c"), ("t2", "two", 1, "d"), ("t1", "same", 3, "e"), ("t1", "same", 3, "e")]
    rows += [("t1", None, 1, "f"), ("t1", None, 2, "g"), (None, "one", 1, "h"), (None, None, 1, "i")]
    latest = access.latest_versions(spark.createDataFrame(rows, "tenant_id string, key string, version_no int, content string"))
    want = [("t1", "one", 1, "a"), ("t1", "two", 2, "c"), ("t2", "two", 1, "d"), ("t1", "same", 3, "e"), ("t1", None, 2, "g"), (None, "one", 1, "h"), (None, None, 1, "i")]
    assert sorted(map(str, latest.collect())) == sorted(map(str, (latest.sparkSession.createDataFrame(want, latest.schema).collect())))
    plan = latest._jdf.queryExecution().optimizedPlan().toString()
    ranked, rest = plan.partition("Window")[2], plan.partition("Window")[0]
    assert "LeftSemi" in ranked and "LeftAnti" in rest  # what is ranked was picked by its keys before
