"""The domain tables derived from the given Parquet tables by hash rules that any SQL engine can repeat (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permlens.functions.hashing import draw, one_of
from permlens.functions.labels import clearance_rank

# The demo principals (subject, tenant, department, projects, clearance, region, role).
PRINCIPALS = [
    ("alice-engineer", "northstar", "engineering", ["atlas"], "internal", "EU", "query"),
    ("bob-support", "northstar", "support", [], "internal", "US", "query"),
    ("carol-manager", "northstar", "engineering", ["atlas", "borealis"], "confidential", "EU", "query"),
    ("dave-contractor", "northstar", None, [], "public", "EU", "query"),
    ("mallory-outsider", "external", "sales", [], "public", "US", "query"),
    ("northstar-admin", "northstar", None, [], None, None, "admin"),
    ("external-admin", "external", None, [], None, None, "admin"),
]
QUERY_PRINCIPALS = [p[0] for p in PRINCIPALS if p[6] == "query"]
UNKNOWN = "nobody-known"  # a subject that no principal has
PRINCIPAL_SCHEMA = (
    "subject string, tenant_id string, department string, projects array<string>, clearance string, region string, role string"
)
AS_OF = "2026-01-15 00:00:00"

NO_LABELS = "cast(array() as array<string>)"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def principals(spark: SparkSession, with_admins: bool = False) -> DataFrame:
    rows = [p for p in PRINCIPALS if with_admins or p[6] == "query"]
    return spark.createDataFrame(rows, PRINCIPAL_SCHEMA).withColumn("clearance_rank", clearance_rank(F.col("clearance")))


def structured(text: Column) -> Column:
    """The lines of a text set out as Markdown: headings, paragraphs, fenced blocks and list items by line number."""

    def line_block(line: Column, i: Column) -> Column:
        slot = i % 8
        return (
            F.when(
                slot == 0,
                F.concat(
                    F.repeat(F.lit("#"), ((i / 8).cast("int") % 3 + 1).cast("int")), F.lit(" Part "), i.cast("string"), F.lit("\n\n"), line
                ),
            )
            .when(slot == 3, F.concat(F.lit("\n"), line))
            .when(slot == 5, F.concat(F.lit("```\n# kept verbatim\n"), line, F.lit("\n```")))
            .when(slot == 6, F.concat(F.lit("- "), line))
            .otherwise(line)
        )

    return F.array_join(F.transform(F.split(text, "\n"), line_block), "\n")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its earlier versions nested, as a manifest lists them; labels that restrict nothing are missing."""
    key = F.col("key")
    labels = (
        given(spark, sf_dir, "documents")
        .select("doc_id", "text", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("key"))
        .withColumn("tenant_id", F.when(draw("tenant", key) % 100 < 10, "external").otherwise("northstar"))
        .withColumn("title", F.concat(F.lit("Title "), key))
        .withColumn("format", F.when(draw("fmt", key) % 2 == 0, "markdown").otherwise("text"))
        .withColumn("content", F.when(F.col("format") == "markdown", structured(F.col("text"))).otherwise(F.col("text")))
        .withColumn("c", draw("class", key) % 100)
        .withColumn(
            "classification",
            F.when(F.col("c") < 15, F.lit(None).cast("string"))
            .when(F.col("c") < 75, "internal")
            .when(F.col("c") < 90, "confidential")
            .otherwise("restricted"),
        )
        .withColumn(
            "allowed_departments",
            F.when(draw("dept?", key) % 100 < 15, F.array(one_of("dept", key, "engineering", "support", "sales"))),
        )
        .withColumn("p", draw("proj", key) % 100)
        .withColumn(
            "required_projects",
            F.when(F.col("tenant_id") != "northstar", F.lit(None))
            .when(F.col("p") < 2, F.array(F.lit("atlas")))
            .when(F.col("p") < 4, F.array(F.lit("borealis"))),
        )
        .withColumn("r", draw("region", key) % 100)
        .withColumn(
            "applies_to_regions", F.when(F.col("r") < 5, F.array(F.lit("EU"))).when(F.col("r") < 10, F.array(F.lit("US")))
        )
        .withColumn("v", draw("valid", key) % 100)
        .withColumn(
            "valid_from",
            F.when(F.col("v") < 3, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
            .when(F.col("v") < 5, F.to_timestamp(F.lit("2099-01-01 00:00:00"))),
        )
        .withColumn("valid_to", F.when(F.col("v") < 3, F.to_timestamp(F.lit("2026-01-01 00:00:00"))))
        .withColumn("s", draw("status", key) % 100)
        .withColumn("status", F.when(F.col("s") < 2, "disabled").when(F.col("s") == 2, "deleted").otherwise("active"))
    )
    earlier = F.struct(
        F.concat(F.col("content"), F.lit("\n\nDraft. Not reviewed.")).alias("content"),
        F.col("format"),
        F.lit("internal").alias("classification"),
        F.lit(None).cast("array<string>").alias("allowed_departments"),
        F.lit(None).cast("array<string>").alias("required_projects"),
        F.lit(None).cast("array<string>").alias("applies_to_regions"),
        F.lit(None).cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return labels.withColumn(
        "history", F.when(draw("ver", key) % 20 == 0, F.array(earlier)).otherwise(F.array().cast("array<void>"))
    ).select(
        "doc_id", "tenant_id", "key", "title", "content", "format", "classification", "allowed_departments", "required_projects",
        "applies_to_regions", "valid_from", "valid_to", "status", "history", "text",
    )


def benchmark_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per benchmark item: its whole text asked by a drawn principal."""
    request_id = F.concat(F.lit("req-"), F.lpad(F.col("item_id").cast("string"), 6, "0"))
    return given(spark, sf_dir, "benchmark").select(
        request_id.alias("request_id"),
        one_of("who", request_id, *QUERY_PRINCIPALS).alias("subject"),
        F.col("text").alias("query"),
        F.to_timestamp(F.lit(AS_OF)).alias("as_of"),
        F.lit(None).cast("string").alias("region"),
    )


def cases(manifest: DataFrame, principal: DataFrame) -> DataFrame:
    """One evaluation case per document: a drawn sentence is the evidence, a drawn principal asks. A case is answerable when the principal
    may read the document, it is active and in scope, and the sentence occurs exactly once in it."""
    from permlens.functions import labels as L
    from permlens.functions import text as T

    case_id = F.concat(F.lit("case-"), F.substring("key", 5, 7))
    parts = F.filter(
        F.transform(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n"), T.strip), lambda s: F.length(s) > 0
    )
    pick = lambda salt: F.try_element_at(
        F.col("parts"), (draw(salt, F.col("key")) % F.greatest(F.size("parts"), F.lit(1))).cast("int") + 1
    )
    asked = (
        manifest.withColumn("case_id", case_id)
        .withColumn("subject", one_of("who", F.col("case_id"), *QUERY_PRINCIPALS))
        .withColumn("parts", parts)
        .withColumn("quote", F.coalesce(pick("line"), F.lit("")))
        .withColumn("other", F.coalesce(pick("ask"), F.lit("")))
        .withColumn("kind", draw("kind", F.col("key")) % 3)
        .withColumn(
            "query",
            F.when(F.col("kind") == 0, F.col("quote"))
            .when(F.col("kind") == 1, F.concat_ws(" ", F.col("other"), F.col("quote")))
            .otherwise(F.col("other")),
        )
        .withColumn("as_of", F.when(draw("asof", F.col("key")) % 2 == 0, F.to_timestamp(F.lit(AS_OF))))
        .withColumn("region", F.when(draw("reg", F.col("key")) % 5 == 0, F.lit("US")))
        .withColumn("normal", T.normalize(F.col("content")))
        .withColumn(
            "found", F.when(F.col("quote") == "", 0).otherwise(F.size(F.split(F.col("normal"), F.concat(F.lit(r"\Q"), "quote", F.lit(r"\E")), -1)) - 1)
        )
    )
    labelled = asked.select(
        "*",
        L.clearance_rank(F.coalesce(F.col("classification"), F.lit("public"))).alias("classification_rank"),
        *[F.coalesce(F.col(c), F.expr(NO_LABELS)).alias(f"{c}_") for c in ("allowed_departments", "required_projects", "applies_to_regions")],
    ).drop("allowed_departments", "required_projects", "applies_to_regions")
    labelled = labelled.withColumnsRenamed({f"{c}_": c for c in ("allowed_departments", "required_projects", "applies_to_regions")})
    joined = labelled.alias("d").join(F.broadcast(principal.alias("p")), "subject")
    decided = joined.select(
        *[F.col(c) for c in ("case_id", "subject", "doc_id", "query", "quote", "found", "as_of", "status")],
        F.col("d.key").alias("key"),
        F.col("d.region").alias("region"),
        F.when(F.size("history") > 0, 2).otherwise(1).alias("version_no"),
        L.authorized("p", "d").alias("allowed"),
        L.in_scope(F.coalesce(F.col("as_of"), F.to_timestamp(F.lit(AS_OF))), F.coalesce("d.region", "p.region"), "d").alias("applies"),
    )
    quoted = (F.length("quote") >= 10) & (F.col("found") == 1)
    answerable = F.col("allowed") & F.col("applies") & (F.col("status") == "active") & quoted
    empty = F.expr(NO_LABELS)
    draw_split = draw("split", F.col("key")) % 10
    evidence = F.struct(F.col("key").alias("document"), F.col("version_no").alias("version"), F.col("quote"))
    tags = F.array(
        F.element_at(F.array(F.lit("lookup"), F.lit("paraphrase"), F.lit("multi")), (draw("tag", F.col("key")) % 3).cast("int") + 1),
        F.when(~F.col("allowed"), "authorization-negative").when(~F.col("applies"), "scope").otherwise("plain"),
    )
    return decided.select(
        "case_id",
        F.when(draw_split < 2, "dev").when(draw_split < 9, "test").otherwise("holdout").alias("split"),
        "query",
        F.col("subject").alias("principal"),
        F.when(answerable, F.array(evidence)).otherwise(F.array().cast("array<struct<document:string,version:int,quote:string>>")).alias("evidence"),
        F.when(answerable, F.array("quote")).otherwise(empty).alias("expected_facts"),
        (~answerable).alias("must_abstain"),
        F.when(~F.col("allowed"), F.array("key")).otherwise(empty).alias("unauthorized_documents"),
        F.array(F.concat(F.lit("doc-"), F.lpad((F.col("doc_id") + 1).cast("string"), 7, "0"))).alias("hard_negative_documents"),
        F.when(F.col("allowed") & ~F.col("applies"), F.array("key"))
        .when(draw("oos", F.col("key")) % 10 == 0, F.array(F.concat(F.lit("doc-"), F.lpad((F.col("doc_id") + 1).cast("string"), 7, "0"))))
        .otherwise(empty)
        .alias("out_of_scope_documents"),
        "as_of",
        "region",
        tags.alias("tags"),
        "doc_id",
        "quote",
    )
