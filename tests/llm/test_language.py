import itertools

import numpy as np
import pytest

from permlens.llm import language as lg
from permlens.llm.common import documents
from permlens.llm.queries import op10_language
from tests.llm.conftest import key, rows_of

EN = "the cat and the dog were sitting on the mat because of this weather with their friends"
DE = "der hund und die katze schliefen auf dem sofa weil das wetter heute nicht schön war"
RU = "собака и кошка спали на диване потому что погода была плохая"
EL = "ο σκύλος και η γάτα κοιμήθηκαν στον καναπέ"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru"), (EL, "el"), (EN, None), (None, "en")] * 3)]
    return lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_the_path_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for _ in range(100):
        scores, n = rng.normal(size=(10, 3)).astype(np.float32) * 3, int(rng.integers(0, 7))
        docs = [rng.integers(0, 10, n), rng.integers(0, 10, n // 2), rng.integers(0, 10, 0)]
        for d, path in zip(docs, lg.viterbi(scores, docs, 2.0)):
            value = lambda p: sum(scores[w][s] for w, s in zip(d, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
            if len(d):
                assert abs(value(path.tolist()) - max(map(value, itertools.product(range(3), repeat=len(d))))) < 1e-4


def test_scripts_narrow_and_spans_part_mixed_texts(spark, model):
    assert model.languages == ["de", "el", "en", "ru"] and model.scripts == [{"latin"}, {"greek"}, {"latin"}, {"cyrillic"}]
    text = f"{EN}. {DE}! {RU}, {EL}?"
    got = lg.spans(spark.createDataFrame([(1, text), (2, None), (3, "123 !")], "doc_id long, text string"), model).orderBy("span").collect()
    assert [(r.doc_id, r.lang) for r in got] == [(1, "en"), (1, "de"), (1, "ru"), (1, "el")]
    assert [text[r.start : r.end] for r in got] == [EN, DE, RU, EL]
    judge = lg.Labeller(model).judge
    assert [x for x, _ in judge([RU[:6], EL[:8], "中文 文字", "", None, "½ ² 12"])] == ["ru", "el", "de", "und", "und", "und"]
    assert judge(["中文"])[0][1] == 0.0 and judge([EN])[0] == ("en", 1.0)


def test_odd_rows(odd, none, model):
    got = lg.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"] and lg.identify(none, model).count() == 0
    by_text = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert by_text.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    assert rows_of(got, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in odd.collect()), key=key)
    empty = lg.fit(none)
    assert empty.languages == [] and {r.lang_pred for r in lg.identify(odd, empty).collect()} == {"und"}


def test_a_single_language(spark):
    one = lg.fit(spark.createDataFrame([(1, EN, "en")], "doc_id long, text string, lang string"))
    assert lg.Labeller(one).judge(["hello", "1"]) == [("en", 1.0), ("und", 0.0)]


def test_held_out_accuracy(spark, given):
    got = op10_language(spark, given).join(documents(spark, given), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0


def test_what_is_learned_and_predicted_leaves_ids_and_sources_out(spark, given):
    docs = documents(spark, given)
    model = lg.fit(docs.where(~lg.held_out()))
    shifted = docs.selectExpr("doc_id + 1000003 as doc_id", "text", "'xx' as lang", "'other' as source")
    a = {r.doc_id + 1000003: (r.lang_pred, r.score) for r in lg.identify(docs, model).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in lg.identify(shifted, model).collect()}
