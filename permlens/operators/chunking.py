"""Documents to chunks: lines, fences, headings, paragraphs, pieces, packed chunks, token budget.

Chunking is local to a document, so every step here is a narrow pass over batches of documents: text is never shuffled, and a corpus of any
size is chunked at the speed it is read. Of a batch of documents a step turns a few at a time into Python strings, and hands on their rows in
batches of bounded number, also within a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from permlens.functions import passages as P
from permlens.functions import text as T

DOC = ["tenant_id", "key", "version_no"]
# The heading pattern.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
BATCH_ROWS = 4_000
PART_DOCUMENTS = 64  # whose texts are Python strings at a time


def per_document(documents: DataFrame, columns: str, rows: Callable[[str, bool], Iterator[tuple]], text: Column | None = None) -> DataFrame:
    """Rows made of each document's normalized text and whether it is Markdown, under the document's identity. No shuffle."""
    schema = StructType([*documents.select(*DOC).schema.fields, *StructType.fromDDL(columns).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, PART_DOCUMENTS) for batch in batches for at in range(0, batch.num_rows, PART_DOCUMENTS)):
            data: list[list] = [[] for _ in names]
            for *identity, format_, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for row in rows(body, format_ == "markdown") if body is not None else ():
                    for column, value in zip(data, (*identity, *row), strict=True):
                        column.append(value)
                    if len(data[0]) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, data, strict=True)))
                        data = [[] for _ in names]
            if data[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(names, data, strict=True)))

    body = T.normalize(F.col("content")) if text is None else text
    form = F.col("format") if "format" in documents.columns else F.lit("text")
    return documents.select(*DOC, form.alias("format"), body.alias("text")).mapInArrow(_typed(run, schema), schema)


def _typed(run, schema: StructType):
    """The batches with exactly the declared types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)], names=arrow.names)

    return typed


def lines(documents: DataFrame) -> DataFrame:
    """One row per line with its character span in the normalized text and whether it is in a code fence."""
    columns = "line_no int, line string, char_start int, char_end int, is_fence boolean, in_fence boolean"
    return per_document(documents, columns, lambda text, md: ((x.number, x.text, x.start, x.start + len(x.text), x.is_fence, x.in_fence) for x in P.lines(text, md)))


def headed_lines(documents: DataFrame) -> DataFrame:
    """Lines with their section number and heading path. A heading of some level is an ancestor as long as no shallower one came later."""
    columns = "line_no int, line string, level int, section_no int, section_path string"
    return per_document(documents, columns, lambda text, md: ((x.number, x.text, x.level, x.section_no, x.section_path) for x in P.lines(text, md)))


def paragraphs(documents: DataFrame) -> DataFrame:
    """Maximal runs of lines between headings and blank lines; a blank line inside a fence does not end one."""
    columns = "section_no int, section_path string, char_start int, char_end int, atomic boolean, text string"
    return per_document(documents, columns, lambda text, md: ((p.section_no, p.section_path, p.start, p.end, atomic, p.text) for p, atomic in P.paragraphs(text, md)))


def sentences(spans: DataFrame) -> DataFrame:
    """The sentences of text spans (char_start, text) with their offsets."""

    def rows(text: str, _: bool) -> Iterator[tuple]:
        at = 0
        for number, part in enumerate(P.sentence_parts(text)):
            sentence = part.rstrip(P.WHITE)
            yield number, at, sentence, at + len(sentence)
            at += len(part)

    found = per_document(spans.withColumn("version_no", F.struct("version_no", "char_start")), "sentence_no int, at int, sentence string, until int", rows, F.col("text"))
    start = F.col("version_no.char_start")
    return found.select(
        "tenant_id", "key", "version_no.version_no", "sentence_no", "sentence", (F.col("at") + start).cast("int").alias("sentence_start"), (F.col("until") + start).cast("int").alias("sentence_end")
    )


def pieces(documents: DataFrame, max_words: int = T.MAX_CHUNK_WORDS) -> DataFrame:
    """What the packer may not split: paragraphs, the sentences of paragraphs over max_words, and cut pieces of whatever is longer than
    the character limit."""
    columns = "section_no int, section_path string, char_start int, char_end int, text string, cut boolean"
    return per_document(documents, columns, lambda text, md: ((p.section_no, p.section_path, p.start, p.end, p.text, p.cut) for p in P.pieces(text, md, max_words)))


CHUNK_COLUMNS = "ordinal int, section_path string, char_start int, char_end int, content string, word_count int"


def _chunk_rows(text: str, spans) -> Iterator[tuple]:
    for ordinal, (start, end, path) in enumerate(spans):
        content = text[start:end]
        yield ordinal, path, start, end, content, P.count_words(content)


def packed_chunks(documents: DataFrame, max_words: int = T.MAX_CHUNK_WORDS, overlap_words: int = T.OVERLAP_WORDS) -> DataFrame:
    """Chunks before the token budget is applied."""
    return per_document(documents, CHUNK_COLUMNS, lambda text, md: _chunk_rows(text, P.packed(text, md, max_words, overlap_words)))


def chunk_documents(documents: DataFrame, max_words: int = T.MAX_CHUNK_WORDS, overlap_words: int = T.OVERLAP_WORDS, max_tokens: int = T.MAX_INPUT_TOKENS) -> DataFrame:
    """(tenant_id, key, version_no, format, content) to chunks within every size limit."""
    return per_document(documents, CHUNK_COLUMNS, lambda text, md: _chunk_rows(text, P.fitted(text, P.packed(text, md, max_words, overlap_words), max_tokens)))


def chunk_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of broken chunk rules per document: text differs from its span, outer whitespace, gaps in ordinals, size limits, words of
    the document outside every chunk (headings are not chunked, so they are allowed there)."""
    texts = documents.select(*DOC, T.normalize(F.col("content")).alias("text"))
    spans = chunks.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("ordinal", "char_start", "char_end", "content"))).alias("c"))
    span_text = lambda c: F.substring(F.col("text"), c["char_start"] + 1, c["char_end"] - c["char_start"])
    count = lambda rule: F.size(F.filter("c", rule))
    gaps = F.filter(
        F.transform(
            "c",
            lambda c, i: F.when(i > 0, F.substring(F.col("text"), F.col("c")[i - 1]["char_end"] + 1, c["char_start"] - F.col("c")[i - 1]["char_end"])),
        ),
        lambda gap: gap.isNotNull(),
    )
    left_out = F.filter(
        F.flatten(F.transform(gaps, lambda gap: F.split(gap, "\n"))), lambda line: (T.strip(line) != "") & ~line.rlike(HEADING)
    )
    return texts.join(spans, DOC).select(
        *DOC,
        count(lambda c: span_text(c) != c["content"]).cast("bigint").alias("text_differs"),
        count(lambda c: T.strip(c["content"]) != c["content"]).cast("bigint").alias("outer_space"),
        F.size(F.filter(F.transform("c", lambda c, i: c["ordinal"] != i), lambda wrong: wrong)).cast("bigint").alias("ordinal_gaps"),
        count(lambda c: F.length(c["content"]) > T.MAX_CHUNK_CHARS).cast("bigint").alias("too_long"),
        F.size(left_out).cast("bigint").alias("lines_left_out"),
    )
