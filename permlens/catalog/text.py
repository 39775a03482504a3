"""Normalization and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.catalog.retrieval import longs
from permlens.catalog.sql import HEADING, normalize, sentence_parts, sql, strip, strip_end, words
from permlens.functions import text as T
from permlens.operators import chunking
from permlens.plans.corpus import Corpus

CHUNK_COLUMNS = ["key", "version_no", "ordinal", "section_path", "char_start", "char_end", "content"]


def short(df: DataFrame) -> DataFrame:
    return longs(df, *[c for c in ("version_no", "ordinal", "char_start", "char_end") if c in df.columns])


def n3(c: Corpus) -> DataFrame:
    rows = chunking.lines(c.current).select("key", "line_no", "char_start", "char_end", F.md5("line").alias("line"))
    return longs(rows, "line_no", "char_start", "char_end")


def n4(c: Corpus) -> DataFrame:
    return longs(chunking.lines(c.current).select("key", "line_no", "is_fence", "in_fence"), "line_no")


def n5(c: Corpus) -> DataFrame:
    return longs(chunking.headed_lines(c.current).select("key", "line_no", "level", "section_no", "section_path"), "line_no", "level", "section_no")


def n6(c: Corpus) -> DataFrame:
    rows = chunking.paragraphs(c.current).select("key", "section_no", "char_start", "char_end", "atomic", F.md5("text").alias("text"))
    return longs(rows, "section_no", "char_start", "char_end")


def n7(c: Corpus) -> DataFrame:
    spans = c.current.select(*chunking.DOC, F.lit(0).alias("char_start"), T.normalize(F.col("content")).alias("text"))
    found = chunking.sentences(spans).select("key", "sentence_start", "sentence_end", F.md5("sentence").alias("sentence"))
    return longs(found.where("sentence_end > sentence_start"), "sentence_start", "sentence_end")


def n8(c: Corpus) -> DataFrame:
    rows = chunking.pieces(c.current).select("key", "section_no", "char_start", "char_end", "cut", F.md5("text").alias("text"))
    return longs(rows, "section_no", "char_start", "char_end")


def n11(c: Corpus) -> DataFrame:
    return short(c.chunks.select("key", "ordinal", F.md5(T.with_context(F.col("section_path"), F.col("content"))).alias("input")))


def n13(c: Corpus) -> DataFrame:
    return chunking.chunk_problems(c.chunks, c.current).drop("tenant_id", "version_no")


QUERIES = {
    "n1_normalize_text": lambda c: c.given("documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"), F.length(T.normalize(F.col("text"))).cast("bigint").alias("n")),
    "n2_content_sha256": lambda c: longs(c.versions.select("key", "version_no", F.sha2(T.normalize(F.col("content")), 256).alias("sha")), "version_no"),
    "n3_line_offsets": n3,
    "n4_fence_state": n4,
    "n5_heading_path": n5,
    "n6_paragraphs": n6,
    "n7_sentence_spans": n7,
    "n8_cut_oversize": n8,
    "n9_pack_chunks": lambda c: short(chunking.packed_chunks(c.current).select(*CHUNK_COLUMNS)),
    "n10_fit_token_budget": lambda c: short(chunking.chunk_documents(c.current).select(*CHUNK_COLUMNS, F.col("word_count").cast("bigint").alias("word_count"))),
    "n11_embedding_input": n11,
    "n12_word_count": lambda c: c.given("documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words")),
    "n13_chunk_invariants": n13,
}

_C = "key, version_no::BIGINT as version_no, ordinal::BIGINT as ordinal, section_path, char_start, char_end, content"
SQL = {
    "n1_normalize_text": f"select doc_id, md5(n) as normal, len(n) as n from (select doc_id, {normalize('text')} as n from documents)",
    "n2_content_sha256": sql(f"select key, version_no::BIGINT as version_no, sha256({normalize('content')}) as sha from version"),
    "n3_line_offsets": sql("select key, line_no::BIGINT as line_no, char_start, char_start + len(line) as char_end, md5(line) as line from line_row"),
    "n4_fence_state": sql("select key, line_no::BIGINT as line_no, is_fence, in_fence from line_row"),
    "n5_heading_path": sql("select key, line_no::BIGINT as line_no, level::BIGINT as level, section_no::BIGINT as section_no, section_path from headed_line"),
    "n6_paragraphs": sql("select key, section_no::BIGINT as section_no, char_start, char_end, atomic, md5(text) as text from paragraph"),
    "n7_sentence_spans": sql(
        f"""select key, s::BIGINT as sentence_start, (s + len(sentence))::BIGINT as sentence_end, md5(sentence) as sentence from (
            select key, coalesce(sum(len(raw)) over (partition by key order by n rows between unbounded preceding and 1 preceding), 0) as s, {strip_end('raw')} as sentence
            from (select key, unnest(p) as raw, generate_subscripts(p, 1) as n from (select key, {sentence_parts('text')} as p from doc_text))) where sentence <> ''"""
    ),
    "n8_cut_oversize": sql("select key, section_no::BIGINT as section_no, char_start::BIGINT as char_start, char_end::BIGINT as char_end, cut, md5(text) as text from piece"),
    "n9_pack_chunks": sql(f"select {_C} from packed_chunk"),
    "n10_fit_token_budget": sql(f"select {_C}, word_count from chunk"),
    "n11_embedding_input": sql("select key, ordinal, md5(case when section_path = '' then content else section_path || chr(10) || chr(10) || content end) as input from chunk"),
    "n12_word_count": f"select doc_id, {words('text')} as words from documents",
    "n13_chunk_invariants": sql(
        f"""select c.key, count(*) filter (substr(t.text, c.char_start::BIGINT + 1, (c.char_end - c.char_start)::BIGINT) <> c.content) as text_differs,
            count(*) filter ({strip('c.content')} <> c.content) as outer_space, count(*) filter (c.ordinal <> c.n) as ordinal_gaps, count(*) filter (len(c.content) > 2000) as too_long,
            coalesce(sum(len(list_filter(string_split(c.gap, chr(10)), lambda x: {strip('x')} <> '' and not regexp_matches(x, '{HEADING}')))), 0)::BIGINT as lines_left_out
        from (select k.*, row_number() over w - 1 as n, substr(d.text, lag(k.char_end) over w + 1, greatest(k.char_start - lag(k.char_end) over w, 0)) as gap
            from chunk k join doc_text d using (key) window w as (partition by k.key order by k.ordinal)) c join doc_text t using (key) group by c.key"""
    ),
}
