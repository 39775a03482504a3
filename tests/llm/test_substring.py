import hashlib
import random

from permlens.llm import substring as ss
from tests.llm.conftest import key, passage, rows_of

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, window=50):
    """Words that stay, per row: every window against all windows of smaller ids."""
    last = 2**63 - 1
    docs = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, last), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append([x for x, g in zip(w, gone) if not g])
    return out


def digests(rows, window=50):
    kept = brute(rows, window)
    return sorted(((i, len((t or "").encode().split()), len((t or "").encode().split()) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (i, t), k in zip(rows, kept)), key=key)


def test_odd_rows_equal_brute_force(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(ss.removed(odd), *COLUMNS) == digests(rows)
    assert ss.removed(none).count() == 0 and ss.deduplicated(none).count() == 0


def test_texts_without_repeats_stay_as_they_are_and_columns_too(odd):
    rows = odd.collect()
    kept = brute([(r.doc_id, r.text) for r in rows])
    want = [(r.doc_id, r.text if r.text is None or k == r.text.encode().split() else b" ".join(k).decode(), r.doc, r.row) for r, k in zip(rows, kept)]
    got = ss.deduplicated(odd)
    assert got.columns == odd.columns
    assert rows_of(got, "doc_id", "text", "doc", "row") == sorted(want, key=key)


def test_hot_passages_windows_and_short_windows(spark, monkeypatch):
    monkeypatch.setattr(ss, "HOT_STRINGS", 3)  # the path of minimisers with very many strings
    rng = random.Random(3)
    shared, other = passage(7, 70), "is on " * 60
    texts = [" ".join([passage(1000 + i, rng.randint(0, 60)), rng.choice([shared, shared[40:300], other, ""]), passage(2000 + i, rng.randint(0, 60))]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(70, texts[0]), (70, texts[1]), (71, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(ss.removed(docs), *COLUMNS) == digests(rows)
    assert rows_of(ss.removed(docs, window=12, mini=4), *COLUMNS) == digests(rows, 12)
