import pytest
from pyspark.sql import functions as F

from permlens.operators import audit
from permlens.sources import files

SCHEMA = "a string, b int"


def test_unknown_fields_are_refused(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"a": "x", "b": 1}\n\n{"a": "y"}\n')
    bad.write_text('{"a": "x", "c": 1}\n')
    assert files.typed_json(spark, str(good), SCHEMA).count() == 2
    with pytest.raises(files.RefusedInput):
        files.typed_json(spark, str(bad), SCHEMA)


def test_answered_requests_need_results(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"case": "c", "status": 200, "latency_ms": 1.0}\n')
    with pytest.raises(files.RefusedInput):
        files.load_requests(spark, str(path))


def test_corpus_files_and_readings(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.md").write_text("# A\nb")
    (tmp_path / "c" / "y.txt").write_text("t")
    got = {(r.file, r.format, r.content) for r in files.corpus_files(spark, str(tmp_path / "c")).collect()}
    assert got == {("x.md", "markdown", "# A\nb"), ("y.txt", "text", "t")}
    csv = tmp_path / "audit.csv"
    csv.write_text("before,10,1\nafter,,\n")
    assert {(r.label, r.bytes, r.rows) for r in files.audit_readings(spark, str(csv)).collect()} == {("before", 10, 1), ("after", None, None)}


def test_export_refuses_an_existing_folder_and_digests_its_lines(spark, tmp_path):
    rows = spark.range(50).select((F.lit(50) - F.col("id")).alias("n"), F.col("id").cast("string").alias("v"))
    manifest = files.export_ndjson(rows, ["n"], str(tmp_path / "out"))
    assert manifest.agg(F.sum("rows")).first()[0] == 50
    with pytest.raises(Exception, match="(?i)already exists"):
        files.export_ndjson(rows, ["n"], str(tmp_path / "out"))


def test_export_must_end_an_hour_ago(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' as occurred_at")
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    assert audit.export_through(rows, F.to_timestamp(F.lit("2024-01-01 23:00:00")), now).count() == 1
    with pytest.raises(Exception, match="one hour"):
        audit.export_through(rows, F.to_timestamp(F.lit("2024-01-01 23:30:00")), now).count()


def test_redaction_keeps_allowed_keys(spark):
    spans = spark.sql("select map('retrieval.k', '5', 'query', 'secret') as attributes, 'e' as events, 's' as status_text")
    row = audit.redact(spans).first()
    assert row.asDict() == {"attributes": {"retrieval.k": "5"}}


def test_corpus_files_are_listed_and_read_in_tasks(spark, tmp_path):
    """Any depth, odd names and bytes; hidden and empty files are left out, and the plan holds no list of the files on the driver."""
    texts = {"a/b/x y.md": "# A\n﻿b", "a/é#1.txt": "t\r\nu", "z.md": "z", "a/b/c/[d]%.txt": "d", "a/=_p/_q=1.txt": "q"}
    for name, text in {**texts, "a/_hidden.txt": "h", ".git/x.md": "h", "a/empty.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    found = files.corpus_files(spark, str(tmp_path))
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
    before = spark.read.text(str(tmp_path), wholetext=True, recursiveFileLookup=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    got = {(r.file, r.content) for r in found.collect()}
    assert got == {tuple(r) for r in before.collect()} and {c for _, c in got} == set(texts.values())
