"""Ranking metrics, gates and latency percentiles. Relevance is the overlap of a result with a labelled span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permlens.functions import text as T
from permlens.operators.numbering import number_rows, running_total

RECORD = ["case_id", "strategy"]
QUALITY = ["recall_5", "recall_10", "mrr_10", "ec_10"]


def _placed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The distinct values of every group with their counts (_c), the rows up to and including them (_place) and the group's rows (_n). Values
    are counted first and placed by distributed running totals, so neither a group nor its distinct values are one task's work."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_total(counted, group, [value], F.col("_c"), "_place")
    sizes = placed.groupBy(*group).agg(F.sum("_c").alias("_n"))
    if not group:
        return placed.withColumn("_n", F.lit(sizes.first()["_n"]))
    match = F.lit(True)
    for g in group:
        match = match & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return placed.alias("a").join(sizes.alias("b"), match).select("a.*", "_n")


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles as values of the data, never interpolated: the value at 0-based place min(n - 1, int(share * n)) of the sorted group."""

    def at(share: float) -> Column:
        place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * share))
        return F.min(F.when(F.col("_place") > place, F.col(value)))

    return _placed(df, group, value).groupBy(*group).agg(*[at(share).alias(name) for name, share in shares.items()], F.max("_n").alias("n"), F.max(value).alias("largest"))


def interpolated(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles between the two values around 0-based place share * (n - 1) of the sorted group."""

    def at(share: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(share)
        below, above = (F.min(F.when(F.col("_place") > p, F.col(value))) for p in (F.floor(place), F.ceil(place)))
        return below + (above - below) * F.max(place - F.floor(place))

    return _placed(df, group, value).groupBy(*group).agg(*[at(share).alias(name) for name, share in shares.items()])


def evidence_spans(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """Each piece of evidence as a character span of its document's normalized text, with how often its quote occurs there."""
    wanted = cases.select("case_id", F.posexplode("evidence").alias("span_no", "e")).select(
        "case_id", "span_no", F.col("e.document").alias("key"), F.col("e.version").alias("version_no"), F.col("e.quote").alias("quote")
    )
    texts = documents.select("key", T.normalize(F.col("content")).alias("text"))
    start = F.instr(F.col("text"), F.col("quote")) - 1
    occurrences = (F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / F.length("quote")
    return wanted.join(texts, "key").select(
        "case_id", "span_no", "key", "version_no", start.alias("span_start"), (start + F.length("quote")).alias("span_end"),
        occurrences.cast("int").alias("occurrences"),
    )


def covering(results: DataFrame, spans: DataFrame) -> DataFrame:
    """Results that cover a span: same document and version, overlapping characters. An interval join with equal case and document."""
    r = results.withColumnRenamed("request_id", "case_id").alias("r")
    s = spans.alias("s")
    same = (F.col("r.case_id") == F.col("s.case_id")) & (F.col("r.key") == F.col("s.key")) & (F.col("r.version_no") == F.col("s.version_no"))
    meets = (F.col("r.char_start") < F.col("s.span_end")) & (F.col("s.span_start") < F.col("r.char_end"))
    return r.join(s, same & meets).select("r.case_id", "r.strategy", "s.span_no", "r.rank", "r.key", "r.ordinal")


def span_hits(results: DataFrame, spans: DataFrame, strategies: DataFrame) -> DataFrame:
    """The first covering rank of every span under every strategy, none where nothing covers it."""
    first = covering(results, spans).groupBy(*RECORD, "span_no").agg(F.min("rank").alias("first_rank"))
    asked = spans.select("case_id", "span_no").withColumn("strategy", F.explode(strategies))
    return asked.join(first, [*RECORD, "span_no"], "left")


def quality(hits: DataFrame) -> DataFrame:
    """recall at 5 and 10, reciprocal rank, evidence coverage and the legacy nDCG per case and strategy."""
    rank = F.col("first_rank")
    within = lambda k: F.count_if(rank <= k) / F.count(F.lit(1))
    gain = lambda r: F.lit(1.0) / F.log2(r + 1)
    ranks = F.collect_set(F.when(rank <= 10, rank))
    dcg = lambda xs: F.aggregate(F.array_sort(xs), F.lit(0.0), lambda a, r: a + gain(r))
    return hits.groupBy(*RECORD).agg(
        within(5).alias("recall_5"),
        within(10).alias("recall_10"),
        F.coalesce(F.lit(1.0) / F.min(F.when(rank <= 10, rank)), F.lit(0.0)).alias("mrr_10"),
        F.avg(F.coalesce(F.when(rank <= 10, gain(rank)), F.lit(0.0))).alias("ec_10"),
        (dcg(ranks) / dcg(F.sequence(F.lit(1), F.least(F.lit(10), F.count(F.lit(1)).cast("int"))))).alias("ndcg_10"),
        F.min("first_rank").alias("first_relevant_rank"),
    )


def negative_ranks(results: DataFrame, cases: DataFrame, strategies: DataFrame) -> DataFrame:
    """The first rank taken by a tempting wrong document, at any depth."""
    tempting = cases.where(F.size("hard_negative_documents") > 0).select("case_id", F.explode("hard_negative_documents").alias("key"))
    hit = results.withColumnRenamed("request_id", "case_id").join(tempting, ["case_id", "key"]).groupBy(*RECORD).agg(F.min("rank").alias("hard_negative_rank"))
    asked = tempting.select("case_id").distinct().withColumn("strategy", F.explode(strategies))
    return asked.join(hit, RECORD, "left")


def violations(results: DataFrame, cases: DataFrame, visibility: DataFrame, current: DataFrame) -> DataFrame:
    """Returned documents outside the principal's visible set, and visible ones returned in another than their current version."""
    seen = visibility.select("principal", F.col("document").alias("key")).distinct().withColumn("visible", F.lit(True))
    found = results.withColumnRenamed("request_id", "case_id").select(*RECORD, "key", "version_no").distinct()
    checked = (
        found.join(cases.select("case_id", "principal"), "case_id")
        .join(seen, ["principal", "key"], "left")
        .join(current.select("key", F.col("version_no").alias("current_no")), "key", "left")
    )
    problem = F.when(F.col("visible").isNull(), F.col("key")).when(
        ~F.col("version_no").eqNullSafe(F.col("current_no")), F.concat("key", F.lit("@v"), F.col("version_no").cast("string"))
    )
    return checked.select(*RECORD, problem.alias("violation")).where("violation is not null").distinct()


def scope_failures(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Returned documents that a case lists as out of its scope."""
    outside = cases.select("case_id", F.explode("out_of_scope_documents").alias("key"))
    found = results.withColumnRenamed("request_id", "case_id").select(*RECORD, "key").distinct()
    return found.join(outside.distinct(), ["case_id", "key"], "left_semi").select(*RECORD, "key")


def case_records(
    results: DataFrame, cases: DataFrame, spans: DataFrame, visibility: DataFrame, current: DataFrame, reviewed: DataFrame, strategies: DataFrame
) -> DataFrame:
    """One row per case and strategy with every metric, check and flag."""
    count = lambda df, name: df.groupBy(*RECORD).agg(F.count(F.lit(1)).alias(name))
    base = cases.select(
        "case_id", "split", "principal", "tags", "must_abstain",
        ((F.size("out_of_scope_documents") > 0) | F.col("as_of").isNotNull() | F.col("region").isNotNull()).alias("scoped"),
    ).withColumn("strategy", F.explode(strategies))
    negative, relevant = F.col("hard_negative_rank"), F.col("first_relevant_rank")
    above = negative.isNotNull() & (relevant.isNull() | (negative < relevant))
    tempted = negative_ranks(results, cases, strategies).withColumn("tempted", F.lit(True))
    return (
        base.join(quality(span_hits(results, spans, strategies)), RECORD, "left")
        .join(tempted, RECORD, "left")
        .join(count(violations(results, cases, visibility, current), "violations"), RECORD, "left")
        .join(count(scope_failures(results, cases), "scope_failures"), RECORD, "left")
        .join(reviewed.select("case_id").distinct().withColumn("reviewed", F.lit(True)), "case_id", "left")
        .withColumn("hard_negative_above_evidence", F.when(F.col("tempted"), above))
        .na.fill(0, ["violations", "scope_failures"])
        .withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
        .drop("tempted")
    )


def summary(records: DataFrame) -> DataFrame:
    """Counts and means per split and strategy, over all cases and over reviewed and unreviewed ones, in one pass."""
    sets = [("split", "strategy", "reviewed"), ("split", "strategy")]
    level = F.when(F.grouping("reviewed") == 1, "all").when(F.col("reviewed"), "reviewed").otherwise("not reviewed")
    return (
        records.groupingSets([[F.col(c) for c in s] for s in sets], "split", "strategy", "reviewed")
        .agg(
            level.alias("labels"),
            F.count("recall_10").alias("answerable_cases"),
            *[F.avg(m).alias(m) for m in QUALITY],
            F.count("hard_negative_above_evidence").alias("hard_negative_cases"),
            F.count_if("hard_negative_above_evidence").alias("hard_negative_above_evidence"),
            F.sum("violations").alias("security_violations"),
            F.count_if("scoped").alias("scope_cases"),
            F.sum("scope_failures").alias("scope_failures"),
        )
        .drop("reviewed")
    )


def recall_by_tag(records: DataFrame, strategies: list[str]) -> DataFrame:
    tagged = records.where(F.col("recall_10").isNotNull()).select(F.explode("tags").alias("tag"), "strategy", "recall_10")
    wide = tagged.groupBy("tag").pivot("strategy", strategies).agg(F.avg("recall_10"))
    return wide.join(tagged.where(F.col("strategy") == strategies[0]).groupBy("tag").agg(F.count(F.lit(1)).alias("cases")), "tag")


def misses(records: DataFrame) -> DataFrame:
    return records.where((F.col("recall_10") < 1) | (F.col("violations") > 0))


def gate(records: DataFrame, ranking_differences: DataFrame) -> DataFrame:
    """2 when anything unauthorized came back, else 3 for a scope failure, else 4 for a changed keyword ranking, else 0."""
    checks = records.agg(F.sum("violations").alias("violations"), F.sum("scope_failures").alias("scope_failures"))
    changed = ranking_differences.agg(F.count(F.lit(1)).alias("changed_rankings"))
    status = F.when(F.col("violations") > 0, 2).when(F.col("scope_failures") > 0, 3).when(F.col("changed_rankings") > 0, 4).otherwise(0)
    tagged = checks.withColumn("one", F.lit(1)).join(changed.withColumn("one", F.lit(1)), "one").drop("one")
    return tagged.withColumn("status", status)


def select_attempts(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Of the recorded attempts of a search, at most `limit`, the first that violates, fails scope or is not degraded; none makes the
    run invalid. Repeats are the attempts before it."""
    ordered = Window.partitionBy("case", "strategy").orderBy("at")
    tried = attempts.withColumn("attempt", F.row_number().over(ordered)).where(F.col("attempt") <= limit)
    stops = (F.col("violations") > 0) | (F.col("scope_failures") > 0) | ~F.col("degraded")
    return tried.groupBy("case", "strategy").agg(
        F.count(F.lit(1)).alias("attempts"), F.min(F.when(stops, F.col("attempt"))).alias("selected")
    ).withColumns({"invalid": F.col("selected").isNull(), "repeats": F.coalesce("selected", "attempts") - 1})


def stratified_holdout(cases: DataFrame, order: Column, share: int = 5) -> DataFrame:
    """A seeded fifth of each stratum of (principal, must abstain, negative), rounded half up."""
    strata = ["principal", "must_abstain", "negative"]
    rows = cases.select("case_id", "principal", "must_abstain", (F.size("unauthorized_documents") > 0).alias("negative"), order.alias("place"))
    sizes = rows.groupBy(*strata).agg(F.floor(F.count(F.lit(1)) / share + 0.5).alias("take"))
    numbered = number_rows(rows, strata, ["place", "case_id"], "nth")
    return numbered.join(F.broadcast(sizes), strata).where(F.col("nth") <= F.col("take")).select("case_id", *strata)


def digest(rows: DataFrame) -> DataFrame:
    """An order-independent digest: the count and the sum of every row's hash, which adds up in any partitioning."""
    number = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rows.columns]), 256), 1, 15), 16, 10)
    total = F.coalesce(F.sum(number.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), total.cast("string").alias("total"))
    return counted.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "total"), 256).alias("digest"))


def field_differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Fields whose values differ between two manifests of (key, map of flattened fields)."""
    b = before.select(key, F.explode("fields").alias("field", "before"))
    a = after.select(key, F.explode("fields").alias("field", "after"))
    return b.join(a, [key, "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def dataset_profile(cases: DataFrame, bands: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Cases by split, principal, tag, overlap band, review and negative, as (dimension, value, cases)."""
    fact = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    facts = (
        cases.join(bands.select("case_id", "band"), "case_id", "left")
        .join(reviewed.select("case_id").distinct().withColumn("r", F.lit(True)), "case_id", "left")
        .select(
            F.explode(
                F.concat(
                    F.array(
                        fact("split", F.col("split")),
                        fact("principal", F.col("principal")),
                        fact("overlap", F.coalesce("band", F.lit("none"))),
                        fact("reviewed", F.when(F.col("r"), "yes").otherwise("no")),
                        fact("negative", F.when(F.size("unauthorized_documents") > 0, "yes").otherwise("no")),
                    ),
                    F.transform("tags", lambda t: fact("tag", t)),
                )
            ).alias("f")
        )
    )
    return facts.groupBy("f.dimension", "f.value").agg(F.count(F.lit(1)).alias("cases"))
