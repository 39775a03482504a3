"""The derived tables of one data folder, each written once per application to the shared folder and read by every plan after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from permlens.functions.hashing import draw
from permlens.functions import labels
from permlens.operators import access, chunking, dense, keyword, metrics
from permlens.operators.fusion import STRATEGIES
from permlens.plans import search
from permlens.session import write_table
from permlens.sources import tables

RUN_STRATEGIES = [*STRATEGIES, "bm25-reference"]

_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            table = build()
            _WRITTEN[key] = (write_table(table, name), table.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    def given(self, name: str) -> DataFrame:
        return tables.given(self.spark, self.sf_dir, name)

    @property
    def run_time(self):
        return F.to_timestamp(F.lit(tables.AS_OF))

    @property
    def principals(self) -> DataFrame:
        return tables.principals(self.spark)

    @property
    def all_principals(self) -> DataFrame:
        return tables.principals(self.spark, with_admins=True)

    @property
    def manifests(self) -> DataFrame:
        return self._once("manifest", lambda: tables.manifests(self.spark, self.sf_dir))

    @property
    def versions(self) -> DataFrame:
        return self._once("version", lambda: access.manifest_versions(self.manifests))

    @property
    def current(self) -> DataFrame:
        return self._once("current", lambda: access.latest_versions(self.versions))

    @property
    def active(self) -> DataFrame:
        return self.current.where("status = 'active'")

    @property
    def chunks(self) -> DataFrame:
        return self._once("chunk", lambda: chunking.chunk_documents(self.current))

    @property
    def candidates(self) -> DataFrame:
        """Numbered chunks of active versions with their labels and scope beside them: the only rows a search reads."""
        labels = ["title", "classification", *access.LABELS, *access.SCOPE, "format"]
        return self._once(
            "candidate", lambda: keyword.number_chunks(self.chunks.join(self.active.select(*chunking.DOC, *labels), chunking.DOC))
        )

    @property
    def postings(self) -> DataFrame:
        return self._once("posting", lambda: keyword.postings(self.candidates))

    @property
    def posting_blocks(self) -> DataFrame:
        return self._once("posting_block", lambda: keyword.posting_blocks(self.candidates))

    @property
    def cases(self) -> DataFrame:
        return self._once("case", lambda: tables.cases(self.manifests, self.principals))

    @property
    def requests(self) -> DataFrame:
        """Benchmark items and evaluation cases, asked."""
        asked = self.cases.select(F.col("case_id").alias("request_id"), F.col("principal").alias("subject"), "query", "as_of", "region")
        return tables.benchmark_requests(self.spark, self.sf_dir).unionByName(asked)

    @property
    def scoped(self) -> DataFrame:
        return self._once(
            "scoped", lambda: keyword.number_requests(access.scoped_requests(self.requests, self.principals, self.run_time))
        )

    @property
    def word_vectors(self) -> DataFrame:
        """Hashed word vectors of the candidates, with the profile they belong to."""

        def build() -> DataFrame:
            text = F.concat_ws("\n", "section_path", "content")
            about = [*access.CHUNK, *keyword.PLACE, *access.LABELS, *access.SCOPE, "label_no", "chunk_no"]
            return dense.with_vectors(self.candidates, text, access.CHUNK).select(*about, "vector").withColumn("profile_id", F.lit("hashing"))

        return self._once("word_vector", build)

    @property
    def scoped_with_vectors(self) -> DataFrame:
        build = lambda: dense.with_vectors(self.scoped, F.col("query"), ["request_id"]).withColumn("profile_id", F.lit("hashing"))
        return self._once("scoped_vector", build)

    def given_vectors(self) -> DataFrame:
        """Candidates with a drawn row of the given embeddings table. The draw is over the table's own row count."""
        embeddings = self.given("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        total = embeddings.count()
        key = F.concat_ws(":", "key", "ordinal")
        about = self.candidates.select(*access.CHUNK, *keyword.PLACE, *access.LABELS, *access.SCOPE, "label_no", "chunk_no")
        drawn = about.withColumn("vec_id", draw("vec", key) % total)
        return drawn.join(embeddings, "vec_id").withColumn("profile_id", F.lit("given"))

    def requests_with_given_vectors(self) -> DataFrame:
        embeddings = self.given("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        drawn = self.scoped.withColumn("vec_id", draw("qvec", F.col("request_id")) % embeddings.count())
        return drawn.join(embeddings, "vec_id").withColumn("profile_id", F.lit("given"))

    @property
    def sparse(self) -> DataFrame:
        return self._once("sparse", lambda: keyword.sparse_topk(self.scoped, self.posting_blocks, self.candidates, 50))

    @property
    def dense(self) -> DataFrame:
        return self._once("dense", lambda: dense.exact_topk(self.scoped_with_vectors, self.word_vectors, 50))

    @property
    def bm25(self) -> DataFrame:
        return self._once("bm25", lambda: keyword.bm25_topk(self.scoped, self.postings, self.posting_blocks, self.candidates, 10))

    @property
    def results(self) -> DataFrame:
        return self._once("result", lambda: search.all_strategies(self.scoped, self.candidates, self.sparse, self.dense, 10))

    @property
    def run_results(self) -> DataFrame:
        """What an evaluation run scores: the four strategies and the BM25 reference."""
        shape = ["request_id", "strategy", "rank", *access.CHUNK, *keyword.PLACE, "score"]
        reference = self.bm25.withColumn("strategy", F.lit("bm25-reference")).select(*shape)
        return self.results.select(*shape).unionByName(reference)

    @property
    def listed_visibility(self) -> DataFrame:
        """Hand-kept visibility lists: the derived ones, but for drawn omissions and drawn additions of hidden documents."""

        def build() -> DataFrame:
            pair = F.concat_ws(":", "principal", "document")
            kept = self.derived_visibility.where(draw("lost", pair) % 50 > 0)
            p, d = self.principals.alias("p"), self.current.alias("d")
            hidden = p.join(d, (F.col("p.tenant_id") == F.col("d.tenant_id")) & ~labels.label_rule("p", "d")).select(
                F.col("subject").alias("principal"), F.col("key").alias("document")
            )
            return kept.unionByName(hidden.where(draw("extra", pair) % 50 == 0))

        return self._once("listed", build)

    @property
    def derived_visibility(self) -> DataFrame:
        return access.visibility_by_tokens(self.current, self.principals).select(F.col("subject").alias("principal"), F.col("key").alias("document"))

    @property
    def labelled_current(self) -> DataFrame:
        """The version each label was written for: the current one, but for drawn documents the one before."""
        behind = (draw("behind", F.col("key")) % 30 == 0).cast("int")
        return self.current.withColumn("version_no", F.col("version_no") - behind)

    @property
    def reviewed(self) -> DataFrame:
        return self.given("labels").select(F.concat(F.lit("case-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("case_id"))

    @property
    def spans(self) -> DataFrame:
        return self._once("span", lambda: metrics.evidence_spans(self.cases, self.current))

    @property
    def records(self) -> DataFrame:
        return self._once("record", lambda: self.records_of(self.run_results))

    def records_of(self, results: DataFrame) -> DataFrame:
        return metrics.case_records(
            results, self.cases, self.spans, self.listed_visibility, self.labelled_current, self.reviewed, F.array(*[F.lit(s) for s in RUN_STRATEGIES])
        )

    @property
    def later_records(self) -> DataFrame:
        """A second run of the same cases that lost its first result for drawn requests and drew no results at all for others."""
        asked = F.col("request_id")
        kept = self.run_results.where(~((draw("run2", asked) % 4 == 0) & (F.col("rank") == 1)))
        return self._once("later_record", lambda: self.records_of(kept).where(draw("gone", F.col("case_id")) % 40 > 0))
