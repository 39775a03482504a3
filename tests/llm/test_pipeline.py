import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from permlens.llm import decontaminate as dc, language as lg
from permlens.llm.common import documents, table
from permlens.llm.queries import tokenizer_path
from tests.llm.conftest import DOCS, key, passage
from tests.llm.test_decontaminate import smith_waterman, words
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_substring import brute as kept_words


@pytest.fixture(scope="module")
def corpus(spark, given):
    """The given documents, with nulls, copies, repeats, leaks and texts without letters added."""
    docs = documents(spark, given)
    items = [r.text for r in table(spark, given, "benchmark").orderBy("item_id").collect()]
    a, b = passage(1, 90), passage(2, 120)
    edited = a.split()
    edited[30] = "changed"
    rows = [(9001, a, "en"), (9002, a, "en"), (9003, " ".join(edited), "en"), (9004, f"{b} {passage(3)}", "en"), (9005, f"{passage(4)} {b}", "fr"), (9006, None, "en"), (9007, "123 --", "en"), (9008, "", None),
            (9009, f"{passage(5)} {items[0]} {passage(6)}", "en"), (9010, items[1], "en"), (None, passage(8), None)]
    return docs.limit(60).unionByName(spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)).cache()


def test_every_stage_equals_brute_force_on_what_the_one_before_kept(spark, given, corpus, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    items = [words(r.text) for r in table(spark, given, "benchmark").collect()]
    docs = corpus
    model = lg.fit(corpus.where(~lg.held_out()))
    judge = lg.Labeller(model).judge
    for n, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
        out = stage(spark, docs, given)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name == "tokens":
            got = sorted(((r.doc_id, r.n_tokens, r.token_ids, r.decoded) for r in docs.collect()), key=lambda r: (r[0] is None, r[0]))
            ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in before]
            assert got == sorted(((i, len(x), x, library.decode(x, skip_special_tokens=False)) for i, x in ids), key=lambda r: (r[0] is None, r[0]))
            continue
        assert docs.columns == corpus.columns
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
        if name == "language":
            want = [(i, t) for i, t, _ in before if judge([t])[0][0] != "und"]
            assert all(any(c.isalpha() for c in t) for _, t in want) and len(want) < len(before)
        elif name == "near_duplicates":
            group = linked([(i, t) for i, t, _ in before], 80, 5)
            want = [(i, t) for i, t, _ in before if any(d == i and c == i for d, _, c in group)]
            assert {9001, 9002, 9003} & {i for i, _ in want} == {9001}
        elif name == "repeated_passages":
            want = [(i, t if k == t.encode().split() else b" ".join(k).decode()) for (i, t, _), k in zip(before, kept_words([(i, t) for i, t, _ in before]))]
            assert [len(t.split()) for i, t in want if i == 9005] == [80]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            leaks = {i for i, t, _ in before if any(smith_waterman(w, words(t)) >= dc.MIN_SCORE * len(w) for w in items)}
            want = [(i, t) for i, t, _ in before if i not in leaks]
            assert {9009, 9010} <= leaks
        assert got == sorted(want, key=key), name


def test_run_is_the_stages_and_is_registered(spark, given):
    got = entry.queries()["pipeline"](spark, given)
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "decoded"] and 0 < got.count() <= documents(spark, given).count()
    assert [name for name in entry.queries() if name.startswith("op")] and not entry.oracle_sql().get("pipeline")
    assert 4 <= len(cp.STAGES) <= 5


def test_an_empty_table_goes_through(spark, given, none, tmp_path):
    docs = none
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, given).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert docs.count() == 0


def test_a_table_without_languages_loses_only_documents_without_letters(spark, given, corpus, tmp_path):
    pytest.importorskip("tokenizers")
    docs = corpus.where("doc_id is null or doc_id > 9000 or doc_id < 20").withColumn("lang", F.lit(None).cast("string"))
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")), key=key)
    first = cp.STAGES[0][1](spark, docs, given)
    assert first.columns == docs.columns and sorted(((r.doc_id, r.text) for r in first.collect()), key=key) == want and len(want) < docs.count()
    for n, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, given).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert {9001, 9004, 9005} <= {r.doc_id for r in docs.collect()}


def test_the_language_stage_drops_what_no_learned_language_could_be(spark, given):
    texts = [(i, passage(i, 30), "en") for i in range(20)] + [(30, "გამარჯობა მსოფლიო", "en"), (31, "გამარჯობა world", None), (32, passage(32, 20), None), (33, "שלום", None), (34, "12", None)]
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in texts], DOCS)
    kept = {r.doc_id for r in cp.identify_language(spark, docs.withColumn("lang", F.when(F.col("doc_id") < 20, F.col("lang"))), given).collect()}
    assert kept == {*range(20), 31, 32}
