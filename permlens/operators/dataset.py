"""Rules an evaluation dataset must keep: one row per problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.functions import text as T

# The least a dataset must offer.
MIN_LOW_OVERLAP_SHARE = 0.30
MIN_NEGATIVES = 25


def problems(
    cases: DataFrame, principals: DataFrame, visibility: DataFrame, derived: DataFrame, documents: DataFrame, spans: DataFrame, bands: DataFrame, reviewed: DataFrame
) -> DataFrame:
    """(subject, problem, detail) for every broken rule. Case-level rules stop at a case whose principal is unknown or unlabelled."""
    visible = visibility.select("principal", "document").distinct()

    def rows(df: DataFrame, subject, problem: str, detail=None) -> DataFrame:
        return df.select(subject.alias("subject"), F.lit(problem).alias("problem"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))

    case = F.col("case_id")
    unknown = cases.join(principals.select(F.col("subject").alias("principal")), "principal", "left_anti")
    known = cases.join(principals.select(F.col("subject").alias("principal")), "principal", "left_semi")
    labelled = known.join(visible.select("principal").distinct(), "principal", "left_semi")
    unlabelled = known.join(visible.select("principal").distinct(), "principal", "left_anti")
    keys = documents.select(F.col("key").alias("document")).distinct()
    evidence = labelled.select("case_id", "principal", F.explode("evidence").alias("e")).select("case_id", "principal", F.col("e.document").alias("document"), F.col("e.version").alias("version"))
    not_visible = evidence.join(visible, ["principal", "document"], "left_anti").join(keys, "document", "left_semi")
    stale = (
        evidence.join(visible, ["principal", "document"], "left_semi")
        .join(documents.select(F.col("key").alias("document"), F.col("version_no").alias("current_no")), "document")
        .where(F.col("version") != F.col("current_no"))
    )
    hidden = labelled.select("case_id", "principal", F.explode("unauthorized_documents").alias("document"))
    negative = labelled.select("case_id", F.explode("hard_negative_documents").alias("document"))
    outside = labelled.select("case_id", "principal", F.explode("out_of_scope_documents").alias("document"))
    tenants = documents.select(F.col("key").alias("document"), F.col("tenant_id").alias("document_tenant"))
    claims = principals.select(F.col("subject").alias("principal"), "tenant_id")
    parts = [
        rows(documents.where(T.normalize(F.col("content")).rlike(r"[\x{10000}-\x{10FFFF}]")), F.col("key"), "character outside the basic plane"),
        rows(documents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("key"), "key used more than once", F.col("n")),
        rows(cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), case, "duplicate case id", F.col("n")),
        rows(unknown, case, "unknown principal", F.col("principal")),
        rows(unlabelled, case, "principal without visibility labels", F.col("principal")),
        rows(labelled.where(F.col("must_abstain") == (F.size("evidence") > 0)), case, "abstaining cases have no evidence, answerable cases need it"),
        rows(evidence.join(keys, "document", "left_anti"), case, "unknown evidence document", F.col("document")),
        rows(spans.where(F.col("occurrences") != 1).join(labelled, "case_id", "left_semi"), case, "quote must occur exactly once", F.col("occurrences")),
        rows(not_visible, case, "evidence is not visible", F.col("document")),
        rows(stale, case, "evidence cites another version", F.col("document")),
        rows(hidden.join(keys, "document", "left_anti"), case, "unknown unauthorized document", F.col("document")),
        rows(hidden.join(visible, ["principal", "document"], "left_semi"), case, "listed as unauthorized but visible", F.col("document")),
        rows(negative.join(keys, "document", "left_anti"), case, "unknown hard negative", F.col("document")),
        rows(outside.join(visible, ["principal", "document"], "left_anti"), case, "out of scope but not visible", F.col("document")),
        rows(
            outside.join(visible, ["principal", "document"], "left_semi").join(evidence.select("case_id", "document").distinct(), ["case_id", "document"], "left_semi"),
            case, "both evidence and out of scope", F.col("document"),
        ),
        rows(
            bands.agg(F.count_if(F.col("band") == "low").alias("low"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 0) & (F.col("low") < MIN_LOW_OVERLAP_SHARE * F.col("n"))),
            F.lit("dataset"), "too few low-overlap paraphrases", F.col("low"),
        ),
        rows(cases.agg(F.count_if(F.size("unauthorized_documents") > 0).alias("n")).where(F.col("n") < MIN_NEGATIVES), F.lit("dataset"), "too few authorization negatives", F.col("n")),
        rows(
            visible.join(claims, "principal").join(tenants, "document").where(F.col("tenant_id") != F.col("document_tenant")),
            F.col("principal"), "lists a document of another tenant", F.col("document"),
        ),
        rows(visible.join(derived, ["principal", "document"], "left_anti"), F.col("principal"), "listed but hidden", F.col("document")),
        rows(derived.join(visible, ["principal", "document"], "left_anti"), F.col("principal"), "admitted but not listed", F.col("document")),
        rows(reviewed.join(cases, "case_id", "left_anti"), case, "review of an unknown case"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def negative_reasons(cases: DataFrame, principals: DataFrame, documents: DataFrame) -> DataFrame:
    """Authorization negatives by the rules that hide the document."""
    asked = cases.select("case_id", "principal", F.explode("unauthorized_documents").alias("key"))
    both = asked.join(F.broadcast(principals.withColumnRenamed("tenant_id", "p_tenant")), F.col("principal") == F.col("subject")).join(
        documents.select("key", "tenant_id", "classification_rank", "allowed_departments", "required_projects"), "key"
    )
    department = (F.size("allowed_departments") > 0) & ~F.coalesce(F.array_contains("allowed_departments", F.col("department")), F.lit(False))
    project = (F.size("required_projects") > 0) & ~F.coalesce(F.arrays_overlap("required_projects", "projects"), F.lit(False))
    return both.groupBy("principal").agg(
        F.countDistinct("case_id").alias("cases"),
        F.count_if(F.col("p_tenant") != F.col("tenant_id")).alias("tenant"),
        F.count_if(F.col("classification_rank") > F.col("clearance_rank")).alias("clearance"),
        F.count_if(department).alias("department"),
        F.count_if(project).alias("project"),
    )
