import hashlib
import math
import random

from pyspark.sql import functions as F

from permlens.operators import metrics, numbering, statistics

RESULT = "request_id string, strategy string, rank int, key string, version_no int, ordinal int, char_start int, char_end int"
SPAN = "case_id string, span_no int, key string, version_no int, span_start int, span_end int"


def test_metrics_of_several_spans(spark):
    results = spark.createDataFrame(
        [("c", "s", 1, "x", 1, 0, 0, 10), ("c", "s", 2, "d", 1, 0, 0, 10), ("c", "s", 3, "d", 2, 1, 20, 30), ("c", "s", 7, "d", 1, 3, 15, 25), ("c", "s", 11, "e", 1, 0, 0, 9)], RESULT
    )
    spans = spark.createDataFrame([("c", 0, "d", 1, 5, 8), ("c", 1, "d", 1, 20, 24), ("c", 2, "e", 1, 0, 5), ("c", 3, "d", 1, 10, 12)], SPAN)
    row = metrics.quality(metrics.span_hits(results, spans, F.array(F.lit("s")))).first()
    assert (row.recall_5, row.recall_10, row.mrr_10) == (0.25, 0.5, 0.5)
    assert math.isclose(row.ec_10, (1 / math.log2(3) + 1 / math.log2(8)) / 4)
    ideal = sum(1 / math.log2(r + 1) for r in range(1, 5))
    assert math.isclose(row.ndcg_10, (1 / math.log2(3) + 1 / math.log2(8)) / ideal)


def test_touching_spans_do_not_cover(spark):
    results = spark.createDataFrame([("c", "s", 1, "d", 1, 0, 0, 10)], RESULT)
    assert metrics.covering(results, spark.createDataFrame([("c", 0, "d", 1, 10, 12)], SPAN)).count() == 0
    assert metrics.covering(results, spark.createDataFrame([("c", 0, "d", 1, 9, 12)], SPAN)).count() == 1


def test_violations_name_hidden_documents_and_old_versions(spark):
    results = spark.createDataFrame([("c", "s", 1, "seen", 1, 0, 0, 1), ("c", "s", 2, "hidden", 1, 0, 0, 1), ("c", "s", 3, "old", 1, 0, 0, 1)], RESULT)
    cases = spark.createDataFrame([("c", "p")], "case_id string, principal string")
    visibility = spark.createDataFrame([("p", "seen"), ("p", "old")], "principal string, document string")
    current = spark.createDataFrame([("seen", 1), ("hidden", 1), ("old", 2)], "key string, version_no int")
    assert {r.violation for r in metrics.violations(results, cases, visibility, current).collect()} == {"hidden", "old@v1"}


def test_nearest_rank_is_a_value_of_the_data(spark):
    for n in (1, 2, 19, 20, 21):
        rows = spark.createDataFrame([("g", float(i)) for i in range(n)], "g string, v double")
        row = metrics.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
        assert (row.p50, row.p95) == (float(n // 2), float(min(n - 1, int(0.95 * n))))


def test_running_totals_of_one_hot_group(spark):
    rows = [("hot", i, i % 5) for i in range(300)] + [("cold", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int, a int").repartition(5)
    got = numbering.running_total(df, ["g"], ["i"], F.col("a"), "t")
    assert got.select("t").distinct().count() > 100
    upto = 0
    for r in got.where("g = 'hot'").orderBy("i").collect():
        upto += r.a
        assert r.t == upto
    assert numbering.ordered_parts(df, ["g"], ["i"]).where("g = 'hot'").select("_part").distinct().count() > 1


def test_attempts(spark):
    rows = [("a", "s", 1, 0, 0, True), ("a", "s", 2, 0, 0, False), ("b", "s", 1, 1, 0, True), ("d", "s", 1, 0, 0, True), ("d", "s", 2, 0, 0, True), ("d", "s", 3, 0, 0, True), ("d", "s", 4, 0, 0, False)]
    df = spark.createDataFrame(rows, "case string, strategy string, at int, violations int, scope_failures int, degraded boolean")
    got = {r.case: (r.attempts, r.selected, r.invalid, r.repeats) for r in metrics.select_attempts(df).collect()}
    assert got == {"a": (2, 2, False, 1), "b": (1, 1, False, 0), "d": (3, None, True, 2)}


def test_holm_keeps_the_running_maximum(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "t string, p double")
    got = {r.t: round(r.p_holm, 6) for r in statistics.holm(df, ["t"]).collect()}
    assert got == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.5}


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-0.2, 0.6), 3) for _ in range(17)]
    df = spark.createDataFrame([("g", f"c{i:02d}", v) for i, v in enumerate(values)], "g string, case_id string, value double")

    def draw(sample, i):
        return int(hashlib.md5(f"boot:{statistics.SEED}:{sample}:{i}".encode()).hexdigest()[:8], 16) % 17

    means = sorted(round(sum(values[draw(s, i)] for i in range(17)) / 17, 9) for s in range(100))
    row = statistics.bootstrap(df, ["g"], 100).first()
    assert math.isclose(row.low, means[2]) and math.isclose(row.high, means[96])
    below, above = sum(m <= 0 for m in means) / 100, sum(m >= 0 for m in means) / 100
    assert math.isclose(row.p, min(1.0, 2 * min(below, above)))


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 2), ("x", 1)], "k string, v int").repartition(3)
    c = spark.createDataFrame([("y", 2), ("x", 3)], "k string, v int")
    first, second, third = (metrics.digest(df).first().digest for df in (a, b, c))
    assert first == second != third


def test_interpolated_percentiles(spark):
    for n in (1, 2, 7, 20):
        values = [float((i * 7) % 5) for i in range(n)]
        row = metrics.interpolated(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
        ordered = sorted(values)

        def at(share):
            place = share * (n - 1)
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            return low + (high - low) * (place - math.floor(place))

        assert math.isclose(row.p50, at(0.5)) and math.isclose(row.p95, at(0.95))


def test_groups_of_one_size_share_their_draws(spark):
    rows = [(g, f"c{i}", float((i * k) % 7)) for k, g in ((1, "a"), (3, "b")) for i in range(11)] + [("d", f"c{i}", float(i)) for i in range(4)]
    got = {(r.g, r.sample): r["mean"] for r in statistics.resampled_means(spark.createDataFrame(rows, "g string, case_id string, value double"), ["g"], 50).collect()}

    def draw(sample, i, n):
        return int(hashlib.md5(f"boot:{statistics.SEED}:{sample}:{i}".encode()).hexdigest()[:8], 16) % n

    for g in "abd":
        values = [v for x, _, v in sorted(r for r in rows if r[0] == g)]
        for s in range(50):
            assert math.isclose(got[g, s], sum(values[draw(s, i, len(values))] for i in range(len(values))) / len(values), abs_tol=1e-8)


def test_runs_that_differ_in_cases_are_refused(spark):
    import pytest

    records = spark.createDataFrame([("c1", "s", 1.0, 0.5, True), ("c2", "s", 0.0, 0.25, True), ("c3", "s", 1.0, 1.0, False)], "case_id string, strategy string, recall_10 double, mrr_10 double, reviewed boolean")
    less = records.where("case_id <> 'c2'").withColumn("mrr_10", F.col("mrr_10") / 2)
    with pytest.raises(ValueError):
        statistics.compare_runs(records, less, ["recall_10", "mrr_10"], ("s", "mrr_10"), 20)
    got = statistics.compare_runs(records, less, ["recall_10", "mrr_10"], ("s", "mrr_10"), 20, allow_subset=True).collect()
    assert {(r.metric, r.cases, r.subset) for r in got} == {("recall_10", 1, True), ("mrr_10", 1, True)}
    assert [r.case_id for r in statistics.changed_cases(records, less).collect()] == ["c1"]
