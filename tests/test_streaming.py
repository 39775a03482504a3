import datetime
import random

from pyspark.sql import functions as F

from permlens.streaming import ingest, leases
from tests.test_versions import STATE, SUBMISSION, brute_plan

LEASE = 1000


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).replace(tzinfo=None)


def run_parts(spark, folder, parts, remember):
    """Runs the lease stream after each part arrived; returns the lapses and the state rows after the last run."""
    rows = 0
    for part in parts:
        spark.createDataFrame([(j, at(ms)) for j, ms in part], "job_id bigint, ts timestamp").write.mode("append").parquet(f"{folder}/arrived")
        stream = leases.lease_lapses(spark.readStream.schema("job_id bigint, ts timestamp").parquet(f"{folder}/arrived"), LEASE, remember)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted((r.job_id, r.attempt, r.lapsed_ms, r.outcome) for r in spark.read.parquet(f"{folder}/out").collect()), rows


def brute(renewals, end):
    out = []
    for job in {j for j, _ in renewals}:
        times, lapses = sorted(t for j, t in renewals if j == job), 0
        for t, following in zip(times, [*times[1:], end]):
            if following - t > LEASE and lapses < 3:
                lapses += 1
                out.append((job, lapses, t + LEASE, "WORKER_LOST" if lapses == 3 else "requeued"))
    return sorted(out)


def test_lapses_equal_brute_force_and_ended_jobs_are_forgotten(spark, tmp_path):
    rng = random.Random(3)
    parts = [[(rng.randrange(12), rng.randrange(p * 6000, (p + 1) * 6000)) for _ in range(90)] for p in range(3)]
    parts[2].append((99, 30_000))  # moves the watermark past everything else
    renewals = [r for p in parts for r in p]
    got, _ = run_parts(spark, str(tmp_path / "long"), parts, 10**9)
    assert got == brute(renewals, 30_000 - 1000)
    quiet = [[(j, 100 * j + 100) for j in range(20)], [(99, 50_000)], [(99, 50_500)], [(99, 51_000)]]
    got, rows = run_parts(spark, str(tmp_path / "short"), quiet, 2000)
    assert got == [(j, 1, 100 * j + 100 + LEASE, "requeued") for j in range(20)]
    assert rows == 1  # the one lease that is open


def test_stretches_hold_no_renewals(monkeypatch):
    import pandas as pd

    batches = [pd.DataFrame({"ms": [t % 700 for t in range(5000)]}), pd.DataFrame({"ms": [2500, 2100, 2999]})]
    assert leases.stretches(iter(batches), LEASE) == [(0, 699), (2100, 2999)]


def test_a_batch_writes_what_it_touches_and_can_be_run_again(spark, tmp_path):
    rng = random.Random(11)
    stored = {f"d{i}": dict(sha="s1", format="text", metadata="m0", status="deleted" if i % 5 == 0 else "active", last=4, owner=3) for i in range(200)}
    initial = spark.createDataFrame([("t", k, s["format"], s["sha"], s["metadata"], s["status"], s["owner"], s["last"], s["owner"]) for k, s in stored.items()], STATE)
    submissions = [("t", f"d{rng.randrange(30)}", f"j{b}", i, f"s{rng.randint(0, 2)}", "text", f"m{rng.randint(0, 1)}") for b in range(2) for i in range(12)]
    folder, each = str(tmp_path / "ingest"), None
    each = ingest.ingest_versions(spark, folder, initial)
    for b in range(2):
        batch = spark.createDataFrame([s for s in submissions if s[2] == f"j{b}"], SUBMISSION)
        each(batch, b)
        first = sorted(map(str, spark.read.parquet(f"{folder}/states/batch={b}").collect()))
        each(batch, b)  # the same batch once more
        assert sorted(map(str, spark.read.parquet(f"{folder}/states/batch={b}").collect())) == first
        assert len(first) == len({s[1] for s in submissions if s[2] == f"j{b}"})
    planned = spark.read.parquet(f"{folder}/planned")
    got = {(r.key, r.job_id, r.ordinal): (r.outcome, r.version_no, r.content_version_no) for r in planned.collect()}
    assert got == brute_plan(submissions, stored)
    final = ingest.newest_states(ingest.state_before(spark, folder, initial, 2))
    assert final.count() == 200 and final.where(F.col("last_version_no") > 4).count() == len({k for (k, _, _), (o, _, _) in got.items() if o != "unchanged"})


def test_a_batch_broadcasts_few_keys_only(spark, tmp_path, monkeypatch):
    """The keys a batch touches are strings, of which the driver holds several copies: they are bounded as other keys are."""
    bounds, small = [], ingest.broadcast_if_small
    monkeypatch.setattr(ingest, "broadcast_if_small", lambda df, *most: bounds.append(most) or small(df, *most))
    each = ingest.ingest_versions(spark, str(tmp_path), spark.createDataFrame([], STATE))
    each(spark.createDataFrame([], SUBMISSION), 0)
    assert bounds == [(ingest.V.BROADCAST_CONTENTS,)] and ingest.V.BROADCAST_CONTENTS <= 100_000
