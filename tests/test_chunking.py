import pyarrow as pa
from pyspark.sql import functions as F

from permlens.functions import text as T
from permlens.operators import chunking as C

SCHEMA = "tenant_id string, key string, version_no int, format string, content string"


def documents(spark, *texts, format="markdown"):
    return spark.createDataFrame([("t", f"d{i}", 1, format, text) for i, text in enumerate(texts)], SCHEMA)


def spans(df):
    return [(r.section_path, r.content) for r in df.orderBy("key", "ordinal").collect()]


def test_headings_fences_and_skipped_levels(spark):
    text = "# A\n\none\n\n```\n# no heading\n\nstill code\n```\n\n### Deep ##\ntwo\n## B\nthree\n# C\nfour"
    assert spans(C.chunk_documents(documents(spark, text))) == [
        ("A", "one\n\n```\n# no heading\n\nstill code\n```"), ("A > Deep", "two"), ("A > B", "three"), ("C", "four"),
    ]


def test_plain_text_has_no_headings(spark):
    assert spans(C.chunk_documents(documents(spark, "﻿# A\r\none\r\n", format="text"))) == [("", "# A\none")]


def test_overlap_repeats_trailing_sentences(spark):
    sentences = [f"Word{i} " + " ".join(["w"] * 18) + "." for i in range(12)]
    chunks = spans(C.chunk_documents(documents(spark, " ".join(sentences))))
    assert len(chunks) == 2
    assert chunks[0][1] == " ".join(sentences[:9])
    assert chunks[1][1] == " ".join(sentences[8:])


def test_oversize_pieces_are_cut_and_never_overlap(spark):
    chunks = C.chunk_documents(documents(spark, "x" * 4500 + " tail", "word " * 700))
    rows = chunks.orderBy("key", "ordinal").collect()
    assert [len(r.content) for r in rows if r.key == "d0"][:2] == [2000, 2000]
    assert all(len(r.content) <= 2000 for r in rows)
    words = [r.word_count for r in rows if r.key == "d1"]
    assert sum(words) == 700 and max(words) <= T.MAX_INPUT_TOKENS - T.SPECIAL_TOKENS


def test_every_rule_holds_on_mixed_documents(spark):
    texts = []
    for seed in range(12):
        parts = []
        for i in range(30):
            n = (seed * 31 + i * 17) % 90 + 1
            body = " ".join(f"w{(seed + i * j) % 50}" + ("." if j % 11 == 0 else "") for j in range(n))
            parts.append(["# Head " + str(i) + "\n" + body, body, "- " + body, "```\n" + body + "\n```", "", body + "\n\n" + body][(seed + i) % 6])
        texts.append("\n".join(parts))
    docs = documents(spark, *texts)
    problems = C.chunk_problems(C.chunk_documents(docs), docs)
    assert problems.count() == 12
    total = problems.agg(*[F.sum(c).alias(c) for c in ("text_differs", "outer_space", "ordinal_gaps", "too_long", "lines_left_out")]).first()
    assert set(total.asDict().values()) == {0}


def test_chunking_shuffles_nothing(spark):
    for made in (C.chunk_documents, C.packed_chunks, C.pieces, C.paragraphs, C.headed_lines, C.lines):
        assert "Exchange" not in made(documents(spark, "a"))._jdf.queryExecution().executedPlan().toString()


def test_rows_leave_in_bounded_batches_within_a_document(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(C, "_typed", lambda run, schema: passes.append(run) or run)
    C.lines(documents(spark, "a"))
    texts = ["\n".join(["x"] * 50_000), None, *["y"] * 1000]
    batch = pa.RecordBatch.from_pydict({"tenant_id": ["t"] * 1002, "key": [str(i) for i in range(1002)], "version_no": [1] * 1002, "format": ["text"] * 1002, "text": texts})
    made = list(passes[0](iter([batch])))
    assert max(b.num_rows for b in made) <= 4_000
    assert sum(b.num_rows for b in made) == 51_000 and [b.column("key")[0].as_py() for b in made][:2] == ["0", "0"] and made[-1].column("key")[-1].as_py() == "1001"


def test_a_noncharacter_shifts_no_offset(spark):
    text = "One \ufdd0 two. Three four.\n- five \ufdd0"
    rows = C.chunk_documents(documents(spark, text), max_words=3).collect()
    assert [text[r.char_start : r.char_end] for r in rows] == [r.content for r in rows] == ["One \ufdd0 two.", "Three four.", "- five \ufdd0"]


def test_embedded_path_keeps_the_innermost_headings(spark):
    rows = spark.createDataFrame([("a > b",), ("x" * 150 + " > " + "y" * 60 + " > z",), ("q" * 300,), ("",)], "p string")
    got = [r.e for r in rows.select(T.embedded_path(F.col("p")).alias("e")).collect()]
    assert got == ["a > b", "y" * 60 + " > z", "q" * 200, ""]


def test_words_terms_and_stemming(spark):
    row = spark.range(1).select(
        T.word_count(F.lit("  two  words ")).alias("n"), T.word_count(F.lit("  ")).alias("none"), T.terms(F.lit("The Policies of buses, class status; gates")).alias("t")
    ).first()
    assert (row.n, row.none, row.t) == (2, 0, ["policy", "buse", "class", "status", "gate"])


def test_a_long_text_without_breaks_is_cut_in_linear_time():
    import time

    from permlens.functions import passages

    start = time.perf_counter()
    spans = passages.cut("x" * 3_000_000, lambda at: at + 100 if 3_000_000 - at > 100 else None, 10**6)
    assert time.perf_counter() - start < 5 and len(spans) == 30_000 and all(n == 100 for _, n in spans)
    text = " ".join(["word"] * 4000)
    assert [text[a : a + n] for a, n in passages.cut(text, lambda at: at + 12 if len(text) - at > 12 else None, 10**6)] == ["word word"] * 2000


def test_a_term_dictionary_takes_any_stemmer(spark):
    from permlens.operators import keyword

    docs = spark.createDataFrame([(1, "Running runs the runner"), (2, "cats and a cat"), (3, None), (4, "")], "id int, text string")

    def load_stemmer():
        return lambda words: ["" if w == "cats" else w[:3] for w in words]

    rows = keyword.dictionary_terms(docs, ["id"], "text", keyword.term_dictionary(docs, "text", load_stemmer)).collect()
    assert {(r.id, r.term, r.n) for r in rows} == {(1, "run", 3), (2, "cat", 1)} and len({r.term_no for r in rows}) == 2
    plain = keyword.dictionary_terms(docs, ["id"], "text", keyword.term_dictionary(docs, "text")).collect()
    assert {(r.id, r.term, r.n) for r in plain} == {(1, "running", 1), (1, "run", 1), (1, "runner", 1), (2, "cat", 2)}
