"""Strict readers and the writers of run results and audit exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permlens.operators.numbering import number_rows, running_totals
from permlens.session import written

CASE_SCHEMA = (
    "case_id string, split string, query string, principal string, evidence array<struct<document:string,version:int,quote:string>>, "
    "expected_facts array<string>, must_abstain boolean, unauthorized_documents array<string>, hard_negative_documents array<string>, "
    "out_of_scope_documents array<string>, as_of timestamp, region string, tags array<string>"
)
REQUEST_SCHEMA = (
    "case string, principal string, strategy string, status int, degraded array<string>, violations array<string>, trace_id string, "
    "latency_ms double, results array<struct<document:string,version:int,start:int,score:double>>"
)


class RefusedInput(ValueError):
    """The input breaks its contract, so nothing is computed from it."""


READ_FILES = 1000  # in a task
READ_BYTES = 16 << 20  # in a batch
FOLDER_FILES = 2000  # where a writer chooses
LISTED = "path string, folder boolean, size long"
QUOTED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]')  # in the name of a file as a URI


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of every file below a folder, however deep, but for hidden and empty ones. Tasks list folders, one level after the other, and
    the driver holds neither the files nor the folders."""
    uri = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{root}/{place}" if place else root))
                for at in range(0, len(found), 10_000):
                    seen = [x for x in found[at : at + 10_000] if not (x.base_name.startswith(".") or x.base_name.startswith("_") and "=" not in x.base_name)]
                    paths = [f"{place}/{x.base_name}" if place else x.base_name for x in seen]
                    yield pa.RecordBatch.from_pydict({"path": paths, "folder": [x.type == fs.FileType.Directory for x in seen], "size": pa.array([x.size for x in seen], pa.int64())})

    level, all_files, open_folders = spark.createDataFrame([("",)], "path string"), None, 1
    while open_folders:
        found = written(level.repartition(min(open_folders, 1000)).mapInArrow(run, LISTED), "listed")
        some = found.where("not folder and size > 0").select("path", "size")
        all_files = some if all_files is None else all_files.unionByName(some)
        level = found.where("folder").select("path")
        open_folders = level.count()
    return all_files


def corpus_files(spark: SparkSession, folder: str, levels: int = 1) -> DataFrame:
    """Whole files as documents, named by the last `levels` parts of their path; the format follows the suffix. Files are found and read in tasks."""
    uri = _uri(folder)
    paths = listed_files(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        whole = [*root.strip("/").split("/")]
        held, size = ([], []), 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}") as file:
                    content = file.read()
                name = "/".join([*whole, *path.split("/")][-levels:])
                held[0].append(QUOTED.sub(lambda m: f"%{ord(m[0]):02X}", name))
                held[1].append(content)
                size += len(content)
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], names=["file", "value"])
                    held, size = ([], []), 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], names=["file", "value"])

    tasks = max(1, -(-paths.count() // READ_FILES))
    read = paths.select("path").repartition(tasks).mapInArrow(run, "file string, value binary")
    return read.select("file", format_of(F.col("file")).alias("format"), F.col("value").cast("string").alias("content"))


def write_texts(texts: DataFrame, folder: str) -> int:
    """One file per (file, content) row below a folder every executor reaches; a task that is run again writes the same. Returns the number
    of files."""
    uri = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        n, made = 0, set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                place = path.rpartition("/")[0]
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                with system.open_output_stream(path) as out:
                    out.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return texts.select("file", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def format_of(path: Column) -> Column:
    return F.when(path.endswith(".md"), "markdown").otherwise("text")


def typed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known shape; a line of another shape or with an unknown field refuses the file. Blank lines are skipped."""
    wanted = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    known = F.array(*[F.lit(f.name) for f in wanted.fields])
    raw = spark.read.text(path).where(F.trim("value") != "")
    unknown = raw.where(F.size(F.array_except(F.json_object_keys("value"), known)) > 0)
    if unknown.limit(1).count():
        raise RefusedInput(f"{path} has fields outside {[f.name for f in wanted.fields]}")
    return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """Recorded search requests; an answered one without its results was not recorded for comparison."""
    rows = typed_json(spark, path, REQUEST_SCHEMA)
    missing = rows.agg(F.count_if((F.col("status") == 200) & F.col("results").isNull())).first()[0]
    if missing:
        raise RefusedInput(f"{missing} answered requests were recorded without results")
    return rows


def stage_readings(spark: SparkSession, path: str) -> DataFrame:
    """Stage timings with a header; an empty reading is unknown."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(
        "strategy", F.col("requests").cast("bigint").alias("requests"),
        *[F.expr(f"cast(nullif({c}, '') as double)").alias(c) for c in rows.columns if c.endswith("_ms")],
    )


def audit_readings(spark: SparkSession, path: str) -> DataFrame:
    """before / after readings of the audit tables, without a header; an empty reading is unknown."""
    rows = spark.read.schema("label string, bytes string, rows string").csv(path)
    return rows.select("label", *[F.expr(f"cast(nullif({c}, '') as bigint)").alias(c) for c in ("bytes", "rows")])


def write_results(results: DataFrame, folder: str) -> None:
    """Per-case records of a run, one folder per run."""
    results.write.mode("error").partitionBy("run_id").json(folder)


FILE_BYTES = 64 << 20
BLOCK_LINES = 1024  # and children of a node of the digest tree


def export_ndjson(rows: DataFrame, order: list[str], folder: str, file_bytes: int = FILE_BYTES, fields: list[str] | None = None) -> DataFrame:
    """Rows (or their `fields`) as JSON lines, oldest first across and within files; refuses an existing folder. A file ends with the line that reaches
    file_bytes. Returns the manifest, the
    `digest_tree` of the lines."""
    ordered_by = [f"_order_{i}" for i in range(len(order))]
    lines = rows.select(*[F.col(c).alias(o) for c, o in zip(order, ordered_by, strict=True)], F.to_json(F.struct(*(fields or ["*"]))).alias("line"))
    lines = running_totals(lines, [], ordered_by, {"n": F.lit(1), "bytes": F.octet_length("line") + 1})
    placed = written(lines.select(((F.col("bytes") - F.octet_length("line") - 1) / file_bytes).cast("long").alias("file_no"), "n", "line"), "export-lines")
    files = max(1, placed.select("file_no").distinct().count())
    # sorted by the very column the writer parts rows by, else it would sort them anew and lose the order of lines
    ordered = placed.withColumn("file", F.format_string("%09d", "file_no")).repartition(files, "file").sortWithinPartitions("file", "n")
    ordered.select("file", F.col("line").alias("value")).write.mode("error").partitionBy("file").text(folder)
    return digest_tree(placed)


def digest_tree(lines: DataFrame, block_lines: int | None = None) -> DataFrame:
    """file_no, rows, digest, manifest_digest of every file of (file_no, n, line); the last is that of the whole. Lines are digested, blocks of
    consecutive lines of a file by their lines' digests, and so on upwards until a file has one; then files likewise. No step holds more
    than a block, and a line that is changed, moved, lost or added shows in the whole's digest. No lines, no files."""
    width = block_lines or BLOCK_LINES
    sizes = lines.groupBy("file_no").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    leaves = lines.join(sizes.select("file_no", "first"), "file_no").select("file_no", (F.col("n") - F.col("first")).alias("i"), F.sha2("line", 256).alias("digest"))
    of_files = _risen(leaves, ["file_no"], sizes.agg(F.max("rows")).first()[0] or 0, width)
    files = written(of_files.join(sizes.select("file_no", "rows"), "file_no"), "file-digests")
    count = files.count()
    numbered = number_rows(files, [], ["file_no"], "nth").select(F.lit(0).alias("file_no"), (F.col("nth") - 1).alias("i"), "digest")
    whole = _risen(numbered, ["file_no"], count, width).select("digest")
    whole = whole.select(F.lit(1).alias("_one"), F.col("digest").alias("manifest_digest"))  # one row
    return files.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("file_no", "rows", "digest", "manifest_digest")


def _risen(nodes: DataFrame, group: list[str], most: int, width: int) -> DataFrame:
    """(group, i, digest) combined `width` at a time, in order, at least once and until each group has one; `most` is the largest group's
    nodes. A group that has one already keeps it, so its digest depends on nothing else."""
    counts = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("left"))
    level, first = nodes.join(counts, group), True
    while first or most > 1:
        joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), ""), 256)
        digest = joined if first else F.when(F.first("left") == 1, F.first("digest")).otherwise(joined)
        level = level.groupBy(*group, F.floor(F.col("i") / width).alias("i_"), F.ceil(F.col("left") / width).alias("left_")).agg(digest.alias("digest"))
        level = level.withColumnsRenamed({"i_": "i", "left_": "left"})
        most, first = -(-most // width), False
    return level.drop("i", "left")


def exported_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file_no, n (from 1 over all files) and text of every line of an export, read in splits: lines are placed by file, split and order."""
    about = F.col("_metadata.file_block_start").alias("split")
    read = spark.read.schema("value string, file string").option("basePath", folder).text(folder)
    lines = written(read.select(F.col("file").cast("long").alias("file_no"), about, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "exported")
    return number_rows(lines, [], ["file_no", "split", "at"], "n").select("file_no", "n", "line")


def export_differences(manifest: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The files whose lines in the folder are not those of the manifest, or that only one side has."""
    found = digest_tree(exported_lines(spark, folder))
    same = F.col("m.file_no").eqNullSafe(F.col("f.file_no"))
    both = manifest.alias("m").join(found.alias("f"), same, "full")
    differs = ~F.col("m.digest").eqNullSafe(F.col("f.digest")) | ~F.col("m.rows").eqNullSafe(F.col("f.rows"))
    return both.where(differs).select(F.coalesce("m.file_no", "f.file_no").alias("file_no"), F.col("m.rows").alias("rows"), F.col("f.rows").alias("found_rows"))
