import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from permlens.llm import filter_audit as fa
from tests.llm.conftest import passage, rows_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """(part, set of failed letters) of every (id, text, source), from the definitions."""
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t, s in rows:
        t = t or ""
        words = SPACE.findall(t)
        found = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": (2**63 - 1 if i is None else i) > first[t]}
        out.append((s or "", {k for k, v in found.items() if v}))
    return out


def brute(rows, good, toxic):
    """The report by running every order over every document."""
    judged = [(p, f, i in good, i in toxic) for (p, f), (i, _, _) in zip(fails(rows), rows)]
    out = {}
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            alive = own
            for step, letter in enumerate(order, 1):
                gone = [j for j in alive if letter in j[1]]
                alive = [j for j in alive if letter not in j[1]]
                failing = [j for j in own if letter in j[1]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(len(j[1]) == 1 for j in failing), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string")


def test_odd_rows(spark, odd, none):
    marks = [(1, 1, 0, "x"), (2, 0, 1, "x"), (2, None, None, "x"), (4, 1, 1, "x"), (9, 1, 0, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (11, None, 1, "x")]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    want = brute(rows, {1, 4, 9}, {2, 4, 11})
    assert rows_of(fa.audit(odd.withColumnRenamed("row", "fails").withColumnRenamed("node", "digest"), labels(spark, marks)), *COLUMNS) == want
    assert fa.audit(none, labels(spark, marks)).count() == 0
    assert rows_of(fa.audit(odd, labels(spark, [])), *COLUMNS) == brute(rows, set(), set())


def test_random_documents_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fa, "HELD_PARTS", 2)
    rng = random.Random(5)
    pool = ["", "a #", "HELLO there", passage(1, 60), passage(1, 60).upper(), passage(2, 60) + " $", "same " * 70, "Same " * 70, passage(3, 49)]
    rows = [(i, rng.choice(pool), rng.choice(["s1", "s2", "", None, "s3"])) for i in range(300)]
    good, toxic = {i for i in range(300) if rng.random() < 0.3}, {i for i in range(300) if rng.random() < 0.1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    marks = labels(spark, [(i, int(i in good), int(i in toxic), "") for i in range(300)])
    assert rows_of(fa.audit(docs, marks), *COLUMNS) == brute(rows, good, toxic)


def test_carry_save_counts_are_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 1000, 4099):
        words = rng.integers(0, 2**32, n, np.uint64).astype(np.uint32)
        want = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
        assert fa.positional_popcount(words).tolist() == want


def test_long_texts_are_counted_whole(monkeypatch):
    text = (" \t".join(f"w{i % 700}" for i in range(5000)) + "\n").encode()
    whole = fa._distinct_words(text)
    monkeypatch.setattr(fa, "PIECE", 100)
    assert fa._distinct_words(text) == whole == (5000, 700) and fa._distinct_words(b"x" * 1000) == (1, 1)
