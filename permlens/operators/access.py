"""Authorization and scope as joins: who may read which version, and what applies to a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permlens.functions import labels as L
from permlens.operators.numbering import running_total
from permlens.operators.spread import spread_join
from permlens.operators.sweep import counts_at
from permlens.session import broadcast_if_small, written

CHUNK = ["tenant_id", "key", "version_no", "ordinal"]
LABELS = ["classification_rank", "allowed_departments", "required_projects"]
SCOPE = ["applies_to_regions", "valid_from", "valid_to"]
ACCESS_LABEL = ["tenant_id", *LABELS, "applies_to_regions"]
PRINCIPAL = ["tenant_id", "department", "projects", "clearance_rank"]


def manifest_versions(manifests: DataFrame) -> DataFrame:
    """One row per document version, oldest first: the nested history, then the current entry. Missing labels restrict nothing."""
    fields = ["content", "format", "classification", "allowed_departments", "required_projects", "applies_to_regions", "valid_from", "valid_to"]
    current = F.struct(*fields)
    none = F.expr("cast(array() as array<string>)")
    listed = F.coalesce(F.col("v.classification"), F.lit("public"))
    return (
        manifests.select("tenant_id", "key", "title", "status", F.posexplode(F.concat("history", F.array(current))).alias("pos", "v"))
        .select(
            "tenant_id",
            "key",
            (F.col("pos") + 1).alias("version_no"),
            "title",
            "v.content",
            "v.format",
            listed.alias("classification"),
            L.clearance_rank(listed).alias("classification_rank"),
            *[F.coalesce(F.col(f"v.{c}"), none).alias(c) for c in ("allowed_departments", "required_projects", "applies_to_regions")],
            "v.valid_from",
            "v.valid_to",
            "status",
        )
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document. Documents with several rows are found by their keys alone, and only their rows are ranked: the one
    row of any other document is neither shuffled nor sorted, unless there are too many of the former to broadcast."""
    document = ["tenant_id", "key"]
    several = versions.groupBy(*document).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*document)
    several = broadcast_if_small(written(several, "several-versions")).alias("s")
    v = versions.alias("v")
    same = F.col("v.tenant_id").eqNullSafe(F.col("s.tenant_id")) & F.col("v.key").eqNullSafe(F.col("s.key"))
    newest = Window.partitionBy(*document).orderBy(F.desc("version_no"))
    ranked = v.join(several, same, "left_semi").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    return v.join(several, same, "left_anti").unionByName(ranked)


def active_versions(versions: DataFrame) -> DataFrame:
    """The only versions that can be retrieved: the newest of each active document. A time in a request never brings an older one back."""
    return latest_versions(versions.where(F.col("status") == "active"))


def label_key(columns: list[str | Column]) -> Column:
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def grants(principals: DataFrame, versions: DataFrame) -> DataFrame:
    """(subject, label key) pairs that the rule admits. It is applied to the distinct rights and the distinct label combinations, which
    are few, and never to principals or documents."""
    holders = principals.select("subject", label_key(PRINCIPAL).alias("rights_key"))
    return holders.join(label_grants(principals, versions), "rights_key").drop("rights_key")


def visible_versions(versions: DataFrame, principals: DataFrame) -> DataFrame:
    """Every admissible (principal, version) pair, by joining versions to the grants of their label combination."""
    labelled = versions.withColumn("label_key", label_key(["tenant_id", *LABELS]))
    identity = [c for c in CHUNK if c in versions.columns] or LABELS
    met = spread_join(grants(principals, versions), labelled, ["label_key"], identity)
    return met.select("w.subject", *[F.col(f"i.{c}") for c in versions.columns])


def scoped_requests(requests: DataFrame, principals: DataFrame, run_time) -> DataFrame:
    """Requests with the asking principal's attributes; the time defaults to the run's and the region to the principal's. A request of an
    unknown subject stays, without attributes, and is admitted to nothing."""
    r = requests.alias("r").join(broadcast_if_small(principals).alias("p"), "subject", "left")
    kept = [c for c in requests.columns if c not in ("subject", "as_of", "region")]
    return r.select(
        "subject",
        *[F.col(f"r.{c}") for c in kept],
        F.coalesce("r.as_of", run_time).alias("as_of"),
        F.coalesce("r.region", "p.region").alias("region"),
        *[F.col(f"p.{c}") for c in PRINCIPAL],
    )


def in_scope_counts(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """scope_no, in_scope, readable: how many versions of its tenant apply to each scope of the numbered requests, and how many of them it may
    read. Versions are counted per access label and along their windows' boundaries; rights meet labels, and times meet counts."""
    counted = versions.groupBy(*ACCESS_LABEL, "valid_from", "valid_to").agg(F.count(F.lit(1)).alias("n")).withColumn("label_key", label_key(ACCESS_LABEL))
    labels = counted.select("label_key", *ACCESS_LABEL).dropDuplicates(["label_key"])
    rights = requests.select("rights_no", *PRINCIPAL, "region", F.col("as_of").isNull().alias("untimed")).dropDuplicates(["rights_no"])
    met = rights.alias("w").join(labels.alias("i"), (F.col("w.tenant_id") == F.col("i.tenant_id")) & L.in_region("w", "i"))
    met = met.select("rights_no", "label_key", L.label_rule("w", "i").alias("readable"))
    scopes = requests.select("scope_no", "rights_no", "as_of").dropDuplicates(["scope_no"])
    held = scopes.join(broadcast_if_small(met), "rights_no")
    at = counts_at(counted.select("label_key", "valid_from", "valid_to", "n"), held.select("label_key", "as_of").distinct(), ["label_key"], ["n"])
    same = (F.col("h.label_key") == F.col("c.label_key")) & F.col("h.as_of").eqNullSafe(F.col("c.as_of"))
    each = held.alias("h").join(at.alias("c"), same).groupBy("h.scope_no")
    return each.agg(F.sum("c.n").alias("in_scope"), F.sum(F.when(F.col("h.readable"), F.col("c.n")).otherwise(0)).alias("readable")).where("in_scope > 0")


def label_grants(principals: DataFrame, versions: DataFrame) -> DataFrame:
    """(rights key, label key) pairs that the rule admits: distinct rights against distinct label combinations."""
    combination = ["tenant_id", *LABELS]
    labels = versions.select(*combination).distinct().withColumn("label_key", label_key(combination))
    rights = principals.select(*PRINCIPAL).distinct().withColumn("rights_key", label_key(PRINCIPAL))
    return rights.alias("p").join(labels.alias("v"), L.authorized("p", "v")).select("p.rights_key", "v.label_key")


def read_decisions(reads: DataFrame, principals: DataFrame, active: DataFrame) -> DataFrame:
    """allow or deny for each (subject, key) read, from the reader's rights and the document's labels: no table of what everyone may read.
    Whatever is missing, hidden, disabled, another tenant's or asked by an unknown subject looks the same. Scope does not apply to reads."""
    holders = principals.select("subject", "tenant_id", label_key(PRINCIPAL).alias("rights_key"))
    labelled = active.select("tenant_id", "key", "title", "version_no", label_key(["tenant_id", *LABELS]).alias("label_key"))
    granted = label_grants(principals, active).withColumn("allowed", F.lit(True))
    joined = reads.join(broadcast_if_small(holders), "subject", "left").join(labelled, ["tenant_id", "key"], "left")
    decided = joined.join(broadcast_if_small(granted), ["rights_key", "label_key"], "left")
    shown = lambda c: F.when(F.col("allowed"), F.col(c)).alias(c)
    return decided.select(*[F.col(c) for c in reads.columns], F.when(F.col("allowed"), "allow").otherwise("deny").alias("decision"), shown("title"), shown("version_no"))


def listing_pages(visible_chunks: DataFrame, page_size: int) -> DataFrame:
    """Everything a principal may read, in key order, with page numbers and the cursor the next page continues after. Chunks are counted
    per document and numbered within it; the documents of a principal are placed by distributed running totals, so a principal who reads
    everything is not one task's work."""
    document = ["subject", "key", "version_no"]
    per_document = visible_chunks.groupBy(*document).agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(per_document, ["subject"], ["key", "version_no"], F.col("n"), "upto").withColumn("first", F.col("upto") - F.col("n"))
    totals = per_document.groupBy("subject").agg(F.sum("n").alias("total"))
    place = F.col("first") + F.col("nth")
    nth = Window.partitionBy(*document).orderBy("ordinal")
    return (
        visible_chunks.withColumn("nth", F.row_number().over(nth))
        .join(starts.drop("n", "upto"), document)
        .join(broadcast_if_small(totals), "subject")
        .withColumn("page", F.floor((place - 1) / page_size).cast("bigint") + 1)
        .withColumn("ends_page", (place % page_size == 0) & (place < F.col("total")))
        .withColumn("next_cursor", F.when(F.col("ends_page"), F.concat_ws("|", "key", "version_no", "ordinal")))
        .select(*document, "ordinal", "page", "next_cursor")
    )


def after_cursor(chunks: DataFrame, key: str, version_no: int, ordinal: int) -> DataFrame:
    """The rows after a cursor as one row-value comparison."""
    place = F.struct("key", F.col("version_no").cast("int").alias("version_no"), F.col("ordinal").cast("int").alias("ordinal"))
    cursor = F.struct(F.lit(key).alias("key"), F.lit(version_no).alias("version_no"), F.lit(ordinal).alias("ordinal"))
    return chunks.where(place > cursor)


def visibility_by_tokens(versions: DataFrame, principals: DataFrame) -> DataFrame:
    """The access rule written a second way, without the shared expression: restrictions become tokens that a principal must hold, and
    versions and principals meet on equal tokens."""
    open_token = F.array(F.lit("*"))
    v = (
        versions.select("tenant_id", "key", "version_no", "classification_rank", "allowed_departments", "required_projects")
        .withColumn("d", F.explode(F.when(F.size("allowed_departments") == 0, open_token).otherwise(F.transform("allowed_departments", lambda x: F.concat(F.lit("="), x)))))
        .withColumn("j", F.explode(F.when(F.size("required_projects") == 0, open_token).otherwise(F.transform("required_projects", lambda x: F.concat(F.lit("="), x)))))
    )
    held = lambda values: F.concat(open_token, F.transform(values, lambda x: F.concat(F.lit("="), x)))
    p = (
        principals.select("subject", "tenant_id", "department", "projects", "clearance_rank")
        .withColumn("d", F.explode(held(F.when(F.col("department").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("department")))))
        .withColumn("j", F.explode(held(F.col("projects"))))
    )
    met = v.join(broadcast_if_small(p), ["tenant_id", "d", "j"])
    return met.where(F.col("classification_rank") <= F.col("clearance_rank")).select("subject", "tenant_id", "key", "version_no").distinct()


def visibility_difference(listed: DataFrame, derived: DataFrame) -> DataFrame:
    """(principal, document) pairs on one side only."""
    a = listed.select("principal", "document").distinct().withColumn("listed", F.lit(True))
    b = derived.select("principal", "document").distinct().withColumn("derived", F.lit(True))
    problem = F.when(F.col("derived").isNull(), "listed but hidden").when(F.col("listed").isNull(), "admitted but not listed")
    return a.join(b, ["principal", "document"], "full").select("principal", "document", problem.alias("problem")).where("problem is not null")


def stricter_grants(principals: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, label key) pairs that the stricter rule of large test corpora admits: every required project, and administrators read nothing.
    An inverted index of requirements: every required project of a label combination meets the principals of the tenant that hold it, and
    a combination is met as often as it has requirements. One without any requires what everyone holds."""
    combination = ["tenant_id", *LABELS]
    labels = documents.select(*combination).distinct().withColumn("label_key", label_key(combination))
    named = lambda values: F.transform(F.array_distinct(values), lambda x: F.concat(F.lit("="), x))
    needs = F.when(F.size("required_projects") == 0, F.array(F.lit("*"))).otherwise(named(F.col("required_projects")))
    wanted = labels.withColumn("needs", needs).select("*", F.explode("needs").alias("token"), F.size("needs").alias("n"))
    readers = principals.where("role <> 'admin'").select("subject", "tenant_id", "department", "clearance_rank", F.explode(F.concat(F.array(F.lit("*")), named(F.col("projects")))).alias("token"))
    met = wanted.alias("d").join(broadcast_if_small(readers).alias("p"), ["tenant_id", "token"])
    department = (F.size("allowed_departments") == 0) | F.coalesce(F.array_contains("allowed_departments", F.col("department")), F.lit(False))
    admitted = met.where((F.col("classification_rank") <= F.col("clearance_rank")) & department)
    return admitted.groupBy("subject", "label_key", "n").agg(F.count(F.lit(1)).alias("held")).where("held = n").select("subject", "label_key")


def stricter_visibility(principals: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, key) pairs under the stricter rule: documents meet the grants of their label combination."""
    labelled = documents.select("key", label_key(["tenant_id", *LABELS]).alias("label_key"))
    return spread_join(stricter_grants(principals, documents), labelled, ["label_key"], ["key"]).select("w.subject", "i.key")


def compared_rules(versions: DataFrame, principals: DataFrame) -> DataFrame:
    """Both writings of the access rule over every label combination, each weighed by its versions: pairs, only_rule, only_tokens. The pairs
    of principals and versions themselves are never made."""
    combination = ["tenant_id", *LABELS]
    counted = versions.groupBy(*combination).agg(F.count(F.lit(1)).alias("n")).withColumn("key", label_key(combination)).withColumn("version_no", F.lit(1))
    first = grants(principals, counted).select("subject", F.col("label_key").alias("key"), F.lit(1).alias("side"))
    second = visibility_by_tokens(counted, principals).select("subject", "key", F.lit(2).alias("side"))
    sides = first.unionByName(second).groupBy("subject", "key").agg(F.sum("side").alias("sides")).join(counted.select("key", "n"), "key")
    weight = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return sides.agg(weight(F.lit(True)).alias("pairs"), weight(F.col("sides") == 1).alias("only_rule"), weight(F.col("sides") == 2).alias("only_tokens"))


