import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

SF = "/root/testdata/sf0.001"
COMPARED = ["a3_authorize_all_principals", "n10_fit_token_budget", "v2_assign_version_numbers", "x3_sparse_topk", "x4_bm25_topk", "l4_load_summary", "o6_audit_purge", "t1_stream_requests_per_minute"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want and got


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_stays_distributed():
    for path in Path(entry.__file__).parent.joinpath("permlens").rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|\.rdd\b", text), path


def test_statements_need_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = str(Path(entry.__file__).parent)
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
