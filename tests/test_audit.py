import pytest
from pyspark.sql import functions as F

from permlens.operators import audit
from permlens.sources import files


def lines_of(folder):
    import glob

    return {path.split("file=")[1].split("/")[0]: open(path, "rb").read() for path in glob.glob(f"{folder}/file=*/part-*")}


def tree(lines, width):
    """The digest of a list of lines, level by level."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(x) for x in lines]
    while True:
        level = [sha("".join(level[i : i + width])) for i in range(0, len(level), width)]
        if len(level) <= 1:
            return level


def test_files_are_bounded_and_digests_are_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_LINES", 4)
    rows = spark.range(200).select((F.lit(500) - F.col("id")).alias("n"), F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")).alias("v")).repartition(5)
    folder = str(tmp_path / "out")
    kept = files.export_ndjson(rows, ["n"], folder, file_bytes=400).collect()
    manifest = {r.file_no: (r.rows, r.digest) for r in kept}
    found = {int(k): v.decode().splitlines() for k, v in lines_of(folder).items()}
    every = [x for k in sorted(found) for x in found[k]]
    assert [int(x.split(":")[1].split(",")[0]) for x in every] == list(range(301, 501))  # oldest first across and within files
    assert len(found) > 5 and all(sum(len(x) + 1 for x in f[:-1]) < 400 for f in found.values())
    digests = [tree(found[k], 4)[0] for k in sorted(found)]
    assert manifest == {k: (len(found[k]), d) for k, d in zip(sorted(found), digests)}
    import hashlib

    whole = digests
    while True:
        whole = [hashlib.sha256("".join(whole[i : i + 4]).encode()).hexdigest() for i in range(0, len(whole), 4)]
        if len(whole) == 1:
            break
    assert {r.manifest_digest for r in kept} == {whole[0]} and sum(r.rows for r in kept) == 200


def test_a_changed_moved_or_lost_line_shows(spark, tmp_path):
    rows = spark.range(60).select("id", F.concat(F.lit("v"), "id").alias("v"))
    folder = str(tmp_path / "out")
    manifest = files.export_ndjson(rows, ["id"], folder, file_bytes=500)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert files.export_differences(manifest, spark, folder).count() == 0
    found = {f: v.decode() for f, v in lines_of(folder).items()}
    second = sorted(found)[1]
    whole = found[second]
    spoilt = [whole.replace("v20", "v2O"), "\n".join(whole.split("\n")[1::-1] + whole.split("\n")[2:]), whole.split("\n", 1)[1], whole]
    for i, text in enumerate(spoilt):
        for f, old in found.items():
            place = tmp_path / f"copy-{i}" / f"file={f}"
            place.mkdir(parents=True)
            (place / "part-0.txt").write_text(text if f == second else old)
        changed = {r.file_no for r in files.export_differences(manifest, spark, str(tmp_path / f"copy-{i}")).collect()}
        assert changed == ({1} if text != whole else set())
    empty = files.export_ndjson(rows.limit(0), ["id"], str(tmp_path / "none")).collect()
    assert empty == []


def test_purges_keep_tables_without_a_cut_off(spark):
    rows = spark.sql("select 'a' as table_name, timestamp'2024-01-01' + make_interval(0, 0, 0, id) as occurred_at, id from range(10) union all select 'b', timestamp'2020-01-01', id from range(5)")
    cut = spark.sql("select 'a' as table_name, timestamp'2024-01-08' as cut_off union all select 'b', null")
    batches = audit.purge_batches(rows, cut, ["occurred_at", "id"], batch=3).orderBy("batch")
    assert [(r.table_name, r.batch, r.removed) for r in batches.collect()] == [("a", 1, 3), ("a", 2, 3), ("a", 3, 1)]
    events = audit.purge_events(batches).collect()
    assert {(e.tenant_id, e.principal_id, e.action, e.resource_id) for e in events} == {("", "system:audit-cleanup", "audit.purge", "a")}
    assert '"rows":3' in events[0].attributes and '"cutOff":"2024-01-08T00:00:00Z"' in events[0].attributes


def test_events_hold_who_did_what_and_nothing_else(spark):
    decided = spark.createDataFrame([("nobody", "doc-1", None, "deny", "t1"), ("ann", "doc-1", "n", "allow", "t2")], "subject string, key string, tenant_id string, decision string, trace_id string")
    reads = {(r.principal_id, r.tenant_id, r.decision, r.attributes) for r in audit.read_events(decided).collect()}
    assert reads == {("nobody", None, "deny", "{}"), ("ann", "n", "allow", "{}")}
    submitted = spark.createDataFrame([("n", "n-admin", "t", "j", 1, "b"), ("n", "n-admin", "t", "j", 0, "a")], "tenant_id string, principal_id string, trace_id string, job_id string, ordinal int, key string")
    assert audit.ingestion_events(submitted).first().attributes == '{"documents":["a","b"]}'
    changes = spark.createDataFrame([("n", "p", "t", "k", "deleted"), ("n", "p", "t", "k", "disabled")], "tenant_id string, principal_id string, trace_id string, key string, status string")
    assert {(r.action, r.attributes) for r in audit.change_events(changes).collect()} == {("document.delete", '{"status":"deleted"}'), ("document.status", '{"status":"disabled"}')}
    jobs = spark.createDataFrame([("j", "n", "done")], "job_id string, tenant_id string, state string")
    lookups = spark.createDataFrame([("j", "n"), ("j", "m"), ("x", "n")], "job_id string, tenant_id string")
    assert {(r.job_id, r.tenant_id, r.state) for r in audit.job_lookup(lookups, jobs).collect()} == {("j", "n", "done"), ("j", "m", None), ("x", "n", None)}


@pytest.mark.parametrize("strategy, reasons, status, ran", [("sparse-only", [], "ok", "s"), ("dense-only", [], "failed", ""), ("hybrid-rrf-rerank", ["rerank_unavailable"], "degraded", "sd"), ("hybrid-rrf-rerank", [], "ok", "sdr")])
def test_records_time_only_the_stages_that_ran(spark, strategy, reasons, status, ran):
    decided = spark.createDataFrame(
        [("r", "n", "p", "t", strategy, status, reasons, "m", "x", "w", True, 3, 5, 7, None, None)],
        "request_id string, tenant_id string, subject string, trace_id string, strategy string, status string, reasons array<string>, embedding_model string, index_profile_id string, reranker_model string, "
        "query_truncated boolean, sparse_ms int, dense_ms int, rerank_ms int, as_of timestamp, region string",
    )
    results = spark.createDataFrame([("r", strategy, "k", 1, 1)], "request_id string, strategy string, key string, version_no int, rank int")
    row = audit.execution_records(decided, results, 10).first()
    assert (row.sparse_ms, row.dense_ms, row.rerank_ms) == tuple(v if c in ran else None for c, v in zip("sdr", (3, 5, 7)))
    assert row.total_ms == sum(v for c, v in zip("sdr", (3, 5, 7)) if c in ran) and (row.embedding_model, row.reranker_model) == ("m" if "d" in ran else None, "w" if "r" in ran else None)
    assert row.documents == ["k@v1"] and row.query_truncated is (True if "r" in ran else None)
