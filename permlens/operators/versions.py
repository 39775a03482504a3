"""Versioned ingestion as set operations over submissions and document state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permlens.functions import labels as L
from permlens.functions import text as T
from permlens.operators import chunking
from permlens.operators.numbering import number_rows, ordered_parts
from permlens.session import broadcast_if_small

DOCUMENT = ["tenant_id", "key"]
METADATA = ["title", "source_uri", "classification", "allowed_departments", "required_projects", "applies_to_regions", "valid_from", "valid_to"]
SETS = ["allowed_departments", "required_projects", "applies_to_regions"]

# Limits of a submission.
KEY_PATTERN = r"^[a-z0-9][a-z0-9._-]*$"
MAX_KEY, MAX_TITLE, MAX_LINK, MAX_CONTENT, MAX_LABELS, MAX_LABEL, MAX_REGION, MAX_JOB = 200, 500, 2000, 500_000, 50, 100, 50, 500
# Retry delays of ingestion jobs.
FIRST_DELAY_SECONDS, MAX_DOUBLINGS, MAX_ATTEMPTS = 5, 10, 5

BROADCAST_CONTENTS = 100_000  # rows of digests or keys: strings, of which the driver holds several copies while it builds the table


def metadata(prefix: str = "") -> Column:
    """Metadata by value: label arrays as sets, a blank link as none, times at microseconds."""
    c = lambda name: F.col(prefix + name)
    return F.struct(
        c("title").alias("title"),
        F.when(T.strip(c("source_uri")) != "", c("source_uri")).alias("source_uri"),
        c("classification").alias("classification"),
        *[L.as_set(c(name)).alias(name) for name in SETS],
        F.date_trunc("microsecond", c("valid_from")).alias("valid_from"),
        F.date_trunc("microsecond", c("valid_to")).alias("valid_to"),
    )


def content_sha(content: Column) -> Column:
    return F.sha2(T.normalize(content), 256)


def plan_versions(submissions: DataFrame, state: DataFrame) -> DataFrame:
    """What each submission does, in the order of each document's submissions, and the version number it writes. It is compared with the
    submission before it, or with the stored active version; a deleted document has no content. Numbers continue after the last one ever
    used, and an unchanged submission uses none. The submissions of one document may span many ordered parts; what one part needs of those
    before it, the last submission and the numbers used, comes from one summary row per document and part."""
    block = [*DOCUMENT, "_part"]
    in_block = Window.partitionBy(*block).orderBy("job_id", "ordinal")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    by_part = Window.partitionBy(*DOCUMENT).orderBy("_part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(F.col("sha"), F.col("format"), F.col("metadata"))
    stored = F.when(
        F.col("s.status") != "deleted",
        F.struct(F.col("s.sha").alias("sha"), F.col("s.format").alias("format"), F.col("s.metadata").alias("metadata")),
    )
    parts = ordered_parts(submissions, DOCUMENT, ["job_id", "ordinal"])
    ends = parts.groupBy(*block).agg(F.max_by(now, F.struct("job_id", "ordinal")).alias("end"))
    starts = ends.select(*block, F.lag("end").over(by_part).alias("carried"), (F.row_number().over(by_part) == 1).alias("opens"))
    rows = (
        parts.alias("n")
        .join(state.alias("s"), DOCUMENT, "left")
        .select(
            *DOCUMENT, "n._part", "n.job_id", "n.ordinal", "n.sha", "n.format", "n.metadata", stored.alias("stored"),
            F.coalesce("s.last_version_no", F.lit(0)).alias("last_version_no"), F.col("s.content_version_no").alias("stored_owner"),
        )
        .join(starts, block)
    )
    first = F.row_number().over(in_block) == 1
    before = F.when(~first, F.lag(now).over(in_block)).when(F.col("opens"), F.col("stored")).otherwise(F.col("carried"))
    same_content = (F.col("before.sha") == F.col("sha")) & (F.col("before.format") == F.col("format"))
    same_metadata = F.col("before.metadata").eqNullSafe(F.col("metadata"))
    outcome = (
        F.when(F.col("before").isNull(), "created")
        .when(same_content & same_metadata, "unchanged")
        .when(same_content, "relabelled")
        .otherwise("updated")
    )
    changed = (F.col("outcome") != "unchanged").cast("int")
    decided = rows.withColumn("before", before).withColumn("outcome", outcome)
    used = decided.groupBy(*block).agg(F.sum(changed).alias("used"))
    shifts = used.select(*block, F.coalesce(F.sum("used").over(earlier), F.lit(0)).alias("shift"))
    wrote = F.when(F.col("outcome").isin("created", "updated"), F.col("version_no"))
    numbered = decided.join(shifts, block).withColumn("version_no", F.col("last_version_no") + F.col("shift") + F.sum(changed).over(upto))
    owners = numbered.groupBy(*block).agg(F.max(wrote).alias("owner"))
    carried_owner = owners.select(*block, F.max("owner").over(earlier).alias("carried_owner"))
    owner = F.coalesce(F.max(wrote).over(upto), F.col("carried_owner"), F.col("stored_owner"))
    return numbered.join(carried_owner, block).select(
        *DOCUMENT, "job_id", "ordinal", "sha", "format", "metadata", "outcome",
        F.when(F.col("outcome") != "unchanged", F.col("version_no")).cast("bigint").alias("version_no"),
        owner.cast("bigint").alias("content_version_no"),
    )


def apply_versions(state: DataFrame, planned: DataFrame) -> DataFrame:
    """The state after a batch: each document points at its newest version; new content revives a deleted document and never re-enables a
    disabled one."""
    written_versions = planned.where(F.col("version_no").isNotNull())
    newest = written_versions.groupBy(*DOCUMENT).agg(
        F.max("version_no").alias("new_version_no"),
        F.max_by("content_version_no", "version_no").alias("new_owner"),
    )
    joined = state.join(newest, DOCUMENT, "full")
    changed = F.col("new_version_no").isNotNull()
    return joined.select(
        *DOCUMENT,
        F.when(F.col("status").isNull() | (changed & (F.col("status") == "deleted")), "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("new_version_no", "active_version_no").cast("bigint").alias("active_version_no"),
        F.greatest("new_version_no", "last_version_no").cast("bigint").alias("last_version_no"),
        F.when(changed, F.col("new_owner")).otherwise(F.col("content_version_no")).cast("bigint").alias("content_version_no"),
    )


def next_state(state: DataFrame, planned: DataFrame) -> DataFrame:
    """apply_versions with the content and metadata the next submissions are compared with."""
    newest = planned.where(F.col("version_no").isNotNull()).groupBy(*DOCUMENT).agg(
        *[F.max_by(c, "version_no").alias(f"new_{c}") for c in ("sha", "format", "metadata")]
    )
    held = state.select(*DOCUMENT, "sha", "format", "metadata").join(newest, DOCUMENT, "full")
    content = held.select(*DOCUMENT, *[F.coalesce(f"new_{c}", c).alias(c) for c in ("sha", "format", "metadata")])
    return apply_versions(state.drop("sha", "format", "metadata"), planned).join(content, DOCUMENT)


def final_status(events: DataFrame) -> DataFrame:
    """Status after ordered (tenant_id, key, at, action) events. Deleting holds until the document is ingested again. The events of one document may
    span many ordered parts; each part is reduced to where it leads from a deleted and from any other status, and the parts are applied
    in order. Within a part, ingestions cut the events into epochs, of which only the last with a status event decides."""
    parts = ordered_parts(events, DOCUMENT, ["at"])
    block = [*DOCUMENT, "_part"]
    upto = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    epochs = parts.withColumn("epoch", F.count_if(F.col("action") == "ingest").over(upto)).groupBy(*block, "epoch").agg(
        F.bool_or(F.col("action") == "deleted").alias("deleted"),
        F.max(F.when(F.col("action") != "ingest", F.struct("at", "action"))).alias("last"),
    )
    told = F.when(F.col("last").isNotNull(), F.struct("epoch", "deleted", "last"))
    per_block = epochs.groupBy(*block).agg(
        F.max("epoch").alias("epochs"), F.max(told).alias("any"), F.max(F.when(F.col("epoch") > 0, told)).alias("revived")
    )

    def ends_in(e: Column) -> Column:
        after_delete = F.when(e["epoch"] == F.col("epochs"), "deleted").otherwise("active")
        return F.when(e["deleted"], after_delete).otherwise(e["last"]["action"])

    from_other = F.when(F.col("any").isNotNull(), ends_in(F.col("any")))
    from_deleted = F.when(F.col("epochs") == 0, "deleted").when(F.col("revived").isNull(), "active").otherwise(ends_in(F.col("revived")))
    steps = per_block.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("_part", from_other.alias("other"), from_deleted.alias("deleted")))).alias("steps"))
    status = F.aggregate("steps", F.lit("active"), lambda s, x: F.when(s == "deleted", x["deleted"]).otherwise(F.coalesce(x["other"], s)))
    return steps.select(*DOCUMENT, status.alias("status"))


def unreachable_versions(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Versions that nothing points at, and all versions of deleted documents. What is kept is the left semi join of the same pointer."""
    pointer = current.where(F.col("status") != "deleted").select(*DOCUMENT, "version_no")
    return versions.join(pointer, [*DOCUMENT, "version_no"], "left_anti")


def content_chunks(contents: DataFrame) -> DataFrame:
    """sha, format, ordinal and the chunk of every different content, made once whatever refers to it. contents are (tenant_id, key,
    version_no, sha, format, content); of equal ones the first by its identity is chunked."""
    identity = ["tenant_id", "key", "version_no"]
    first = contents.groupBy("sha", "format").agg(F.min(F.struct(*identity)).alias("first")).select("sha", "format", *[F.col(f"first.{c}").alias(c) for c in identity])
    one = contents.drop("sha").join(broadcast_if_small(first.select(*identity), BROADCAST_CONTENTS), identity, "left_semi")
    return chunking.chunk_documents(one).join(first, identity).drop(*identity)


def unreachable_chunks(gone: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """The chunks of each unreachable version's content: chunk_counts are (sha, format, chunks)."""
    return gone.join(chunk_counts, ["sha", "format"], "left").na.fill(0, ["chunks"])


def submission_errors(submissions: DataFrame) -> DataFrame:
    """Every rule each submission breaks; an empty list is clean."""

    def plain(name: str, longest: int) -> Column:
        values = F.col(name)
        wrong = F.exists(values, lambda v: (T.strip(v) == "") | (F.length(v) > longest) | v.rlike(r"\p{Cntrl}"))
        return F.when((F.size(values) > MAX_LABELS) | wrong, F.lit(name))

    blank = lambda name: T.strip(F.coalesce(F.col(name), F.lit(""))) == ""
    rules = [
        F.when(blank("key") | (F.length("key") > MAX_KEY) | ~F.col("key").rlike(KEY_PATTERN), F.lit("key")),
        F.when(blank("title") | (F.length("title") > MAX_TITLE), F.lit("title")),
        F.when(F.length("source_uri") > MAX_LINK, F.lit("source_uri")),
        F.when(blank("content") | (F.length("content") > MAX_CONTENT) | F.contains("content", F.lit(T.MARK)), F.lit("content")),
        F.when(~F.col("format").isin("markdown", "text"), F.lit("format")),
        F.when(~F.col("classification").isin(*L.LEVELS), F.lit("classification")),
        plain("allowed_departments", MAX_LABEL),
        plain("required_projects", MAX_LABEL),
        plain("applies_to_regions", MAX_REGION),
        F.when(F.col("valid_from") >= F.col("valid_to"), F.lit("validity")),
    ]
    return submissions.withColumn("errors", F.array_compact(F.array(*rules)))


def oversized_jobs(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy("job_id").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > MAX_JOB)


def job_counters(planned: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Per job: documents created, updated, unchanged, processed, and the chunks of the contents written; chunk_counts are (sha, format,
    chunks). A relabelling updates without writing chunks."""
    wrote = F.col("outcome").isin("created", "updated")
    return planned.join(broadcast_if_small(chunk_counts, BROADCAST_CONTENTS), ["sha", "format"], "left").groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome").isin("updated", "relabelled")).alias("updated"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
        F.count(F.lit(1)).alias("processed"),
        F.sum(F.when(wrote, F.coalesce("chunks", F.lit(0))).otherwise(0)).alias("chunks"),
    )


def replay_rounds(versions: DataFrame, loaded: DataFrame, batch_size: int = 200) -> DataFrame:
    """The rounds that replay histories so that every current version lands in the last one; documents already loaded contribute only
    their current version. Within a round, versions go in batches in order of tenant and key."""
    counts = versions.groupBy(*DOCUMENT).agg(F.max("version_no").alias("n"))
    pending = (
        versions.select(*DOCUMENT, "version_no")
        .join(counts, DOCUMENT)
        .join(loaded.select(*DOCUMENT).withColumn("loaded", F.lit(True)), DOCUMENT, "left")
        .where(F.col("loaded").isNull() | (F.col("version_no") == F.col("n")))
    )
    rounds = pending.agg(F.max(F.when(F.col("loaded").isNull(), F.col("n")).otherwise(1))).first()[0]
    placed = pending.withColumn("round", F.lit(rounds) - F.col("n") + F.col("version_no"))
    numbered = number_rows(placed.select(*DOCUMENT, "version_no", "round"), ["round"], DOCUMENT, "nth")
    return numbered.withColumn("batch", F.floor((F.col("nth") - 1) / batch_size) + 1).drop("nth")


# What makes vectors comparable.
PROFILE_FIELDS = (
    "embedding_model", "embedding_revision", "dimensions", "query_prefix", "passage_prefix", "embedding_context", "chunker_release", "chunk_max_words", "chunk_overlap_words",
    "chunk_max_tokens", "chunk_max_chars", "heading_max_chars", "chunk_tokenizer",
)


def profile_report(profiles: DataFrame, anchor: dict[str, str]) -> DataFrame:
    """The distinct index profiles in use, the fields in which each differs from the anchor, and whether profiles are mixed."""
    fields = list(anchor)
    used = profiles.groupBy(*fields).agg(F.count(F.lit(1)).alias("versions"))
    kinds = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.lit(v)), F.lit(f)) for f, v in anchor.items()]))
    return used.select(
        F.sha2(F.concat_ws("|", *fields), 256).alias("profile_id"), "versions", F.array_join(differs, ",").alias("differs"), (kinds > 1).alias("mixed")
    )


def chunker_releases(chunker_versions: DataFrame) -> DataFrame:
    """Releases in use; formats of one release are one release."""
    used = chunker_versions.groupBy(F.substring_index("chunker_version", "/", -1).alias("release")).agg(F.count(F.lit(1)).alias("documents"))
    return used.withColumn("mixed", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > 1)


def job_states(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The state of each job from its ordered (job_id, at, kind) events: succeeded and exhausted are final, a failed attempt waits twice
    as long each time, a lost lease uses up an attempt and is taken over without a wait, anything else is running. The events of one job may span many ordered parts; each part is reduced to its failures
    before a success, its failures and its last kind, and the parts are applied in order."""
    parts = ordered_parts(events, ["job_id"], ["at"])
    block = ["job_id", "_part"]
    failed, succeeded = F.col("kind").isin("attempt_failed", "lease_lost"), F.col("kind") == "succeeded"
    won_at = F.min(F.when(succeeded, F.col("at"))).over(Window.partitionBy(*block))
    per_block = parts.withColumn("won_at", won_at).groupBy(*block).agg(
        F.count_if(failed & (F.col("at") < F.col("won_at"))).alias("failed_first"),
        F.bool_or(succeeded).alias("won"),
        F.count_if(failed).alias("failed"),
        F.max_by("kind", "at").alias("last"),
    )
    steps = per_block.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("_part", "failed_first", "won", "failed", "last"))).alias("steps"))

    def state(name: Column, failures: Column) -> Column:
        return F.struct(name.alias("state"), failures.cast("bigint").alias("failures"))

    def step(s: Column, x: Column) -> Column:
        failures = s["failures"] + F.when(x["won"], x["failed_first"]).otherwise(x["failed"])
        return (
            F.when(s["state"].isin("succeeded", "failed"), s)
            .when(failures >= max_attempts, state(F.lit("failed"), F.lit(max_attempts)))
            .when(x["won"], state(F.lit("succeeded"), failures))
            .otherwise(state(F.when(x["last"] == "attempt_failed", "queued").otherwise("running"), failures))
        )

    ended = steps.select("job_id", F.aggregate("steps", state(F.lit("running"), F.lit(0)), step).alias("s"))
    delay = F.when(
        F.col("s.state") == "queued", F.lit(FIRST_DELAY_SECONDS) * F.pow(F.lit(2), F.least(F.col("s.failures") - 1, F.lit(MAX_DOUBLINGS)))
    )
    return ended.select("job_id", "s.state", "s.failures", delay.cast("bigint").alias("retry_seconds"))
