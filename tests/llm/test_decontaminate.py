import random

import numpy as np

from permlens.llm import decontaminate as dc
from permlens.llm.common import documents, table
from tests.llm.conftest import key, passage, rows_of


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def words(text):
    return [x for w in (text or "").encode().split() if (x := w.decode().lower().strip(dc.EDGE))]


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(1, 5, rng.integers(1, n)).astype(np.uint64) for n in (9, 20))
        assert dc.align(a, b).max() == smith_waterman(a.tolist(), b.tolist())


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    items = [(i, passage(i, rng.randint(12, 50)).capitalize() + ".") for i in range(20)] + [(20, None), (21, "two words"), (22, ""), (None, passage(70, 20)), (5, passage(71, 20))]
    docs, want = [], set()
    for d in range(120):
        i, item = rng.choice(items[:20])
        own = item.split()
        for _ in range(rng.choice([0, 0, 1, len(own) // 10, len(own) // 3])):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["changed"], [], [own[at], "more"], [own[at].upper() + ","]])
        text = " ".join([passage(1000 + d, rng.randint(0, 80)), *(own if d % 3 else []), passage(2000 + d, rng.randint(0, 80))])
        docs.append((d, text))
    docs += [(None, items[0][1]), (7, items[1][1]), (200, None), (201, ""), (202, " ".join(["the"] * 500)), (203, items[23][1])]
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if len(w) >= 3 and smith_waterman(w, words(text)) >= 0.6 * len(w):
                want.add((d, i))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, score string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(df, benchmark)
    assert rows_of(got, "doc_id", "item_id") == sorted(want, key=key)
    by = dict(docs[:120])
    for r in got.where("doc_id < 120 and doc_id <> 7 and score = 1").collect():
        assert words(" ".join(by[r.doc_id].split()[r.start_word : r.end_word])) == words(dict(items[:20])[r.item_id])
    kept = dc.clean(df, benchmark)
    leaked = {d for d, _ in want}
    assert kept.columns == df.columns and rows_of(kept, "doc_id", "text") == sorted(((d, t) for d, t in docs if d not in leaked or (d == 7 and not any((d, i) in want and smith_waterman(words(x), words(t)) >= 0.6 * len(words(x)) for i, x in items if x and len(words(x)) > 2))), key=key)


def test_blocks_of_items_and_empty_tables(spark, given, none, odd, monkeypatch):
    docs, benchmark = documents(spark, given), table(spark, given, "benchmark")
    whole = rows_of(dc.leaks(docs, benchmark), "doc_id", "item_id", "score", "start_word", "end_word")
    quoted = {(d.doc_id, b.item_id) for b in benchmark.collect() for d in docs.collect() if b.text in d.text}
    assert quoted and quoted <= {r[:2] for r in whole}
    monkeypatch.setattr(dc, "FILTER_BITS", 6)  # hardly a sequence is dropped
    monkeypatch.setattr(dc, "WIDE_ROWS", 1)
    monkeypatch.setattr(dc, "broadcast_if_small", lambda df, *a: df)
    assert rows_of(dc.leaks(docs, benchmark), "doc_id", "item_id", "score", "start_word", "end_word") == whole
    assert dc.leaks(none, benchmark).count() == 0 and dc.clean(none, benchmark).count() == 0
    assert dc.leaks(docs, benchmark.limit(0)).count() == 0 and dc.clean(odd, benchmark.limit(0)).count() == odd.count()
    assert dc.clean(odd, benchmark).count() == odd.count()


def test_a_lone_edited_copy_is_found_wherever_its_edits_are(spark):
    """One copy of each item in the whole table, with a word replaced or inserted at even distances, besides groups of other copies."""
    rng = random.Random(9)
    items = [(i, passage(300 + i, n)) for i, n in enumerate([*range(3, 16), *rng.choices(range(15, 60), k=40)])]
    docs, own = [], {i: t.split() for i, t in items}
    for i, _ in items:
        for step in (2, 3, 4, 5, 6):
            for insert in (False, True):
                copy = [x for at, w in enumerate(own[i]) for x in ([w, "added"] if insert and at % step == step - 1 else ["changed"] if not insert and at % step == step // 2 else [w])]
                docs.append(" ".join([passage(5000 + len(docs), rng.randint(0, 30)), *copy, passage(7000 + len(docs), rng.randint(0, 30))]))
    docs += [" ".join(w for at, w in enumerate(own[i]) if at % 7 > 3 or at % 7 == 0) for i in list(own)[20:30] for _ in range(5)]
    texts = [words(t) for t in docs]
    want = {(d, i) for d, t in enumerate(texts) for i, w in own.items() if len(set(w) & set(t)) >= 0.6 * len(w) and smith_waterman(w, t) >= 0.6 * len(w)}
    alone = [(10 * i + at, i) for i in own for at in range(10)]
    assert sum(p in want for p in alone) > 100
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert rows_of(dc.leaks(df, spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id") == sorted(want)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "two words"), (2, "Yes."), (3, "東京特許許可局の庭"), (4, "ภาษาไทยไม่มีช่องว่าง"), (5, "中")]
    docs = [(1, "Two words!"), (2, "two words more"), (3, "yes"), (4, "yes yes"), (5, "今日は東京特許許可局の庭に行く"), (6, "東京都の庭"), (7, "ไทย ภาษาไทยไม่มีช่องว่าง"), (8, "中"), (9, "中国"), (None, "two words"), (10, None), (11, "東京特許許可所の庭")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 1), (3, 2), (5, 3), (7, 4), (8, 5), (11, 3), (None, 1)]
    assert rows_of(dc.leaks(df, benchmark), "doc_id", "item_id") == want
    assert rows_of(dc.clean(df, benchmark), "doc_id") == [(i,) for i in (2, 4, 6, 9, 10)]


def test_seeds_of_a_text_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(dc, "EXPAND", 5)
    numbers = dc.Words()
    own = [numbers(passage(i, 30))[0] for i in range(6)]
    items = dc.Items(list(range(6)), own, dc.MIN_SCORE)
    assert [(t, i) for t, i, *_ in dc.find([own[2], own[0][:2], np.concatenate([own[1], own[4]]), own[5]], items)] == [(0, 2), (2, 1), (2, 4), (3, 5)]
