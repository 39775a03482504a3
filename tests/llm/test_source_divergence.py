import random
import re
from collections import Counter, defaultdict

import pytest

from permlens.llm import source_divergence as sd
from tests.llm.conftest import passage, rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=30, top=50):
    """(lang, source, text) rows to the report, group by group and term by term."""
    rows = [tuple(v or "" for v in r) for r in rows]
    found = [(lang, source, TERM.findall(text.translate(UPPER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, t) for g, s, t in found if g == lang]
        docs, counts = Counter(), defaultdict(Counter)
        for s, terms in own:
            docs.update(set(terms))
            counts[s].update(terms)
        kept = [t for t, n in docs.items() if n >= least]
        sources = sorted(counts)

        def chance(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        total = {s: sum(counts[s][t] for t in kept) for s in sources}
        p = {s: {t: chance(counts[s][t], total[s]) for t in kept} for s in sources}
        q = {t: chance(sum(counts[s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            typical = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", typical, top)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    extra = odd.withColumnRenamed("row", "cells").withColumnRenamed("node", "documents").withColumnRenamed("key", "term")
    assert rows_of(sd.divergences(extra), *COLUMNS) == brute(rows)  # hardly a term in 30 documents: pairs of value 0
    assert rows_of(sd.divergences(odd, 2, 3), *COLUMNS) == brute(rows, 2, 3)
    assert sd.divergences(none).count() == 0


@pytest.mark.parametrize("bounds", [None, (50, 8, 3)])
def test_random_documents(spark, bounds, monkeypatch):
    """Also with bounds so low that stripes, sums and matrices are cut all the time."""
    if bounds:
        monkeypatch.setattr(sd, "SPILL_ENTRIES", bounds[0])
        monkeypatch.setattr(sd, "CELLS", bounds[1])
        monkeypatch.setattr(sd.Pairs, "LIMIT", bounds[2])
        monkeypatch.setattr(sd, "PIECE", 40)
    rng = random.Random(3)
    pool = passage(7, 60).split() + ["É", "Ünï", "中文", "A1b", "it's", "x\x7fy", "\xa0z"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S10", None, "é"])
        start = (hash_of(source) * 13) % 30
        rows.append((lang, source, " ".join(rng.choice(pool[start : start + 40]).title() for _ in range(rng.randint(0, 25)))))
    rows += [("fr", "s1", "seul"), ("fr", "s2", None), ("it", None, "x")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    want = brute(rows)
    assert any(r[2] == "term" for r in want) and rows_of(sd.divergences(docs), *COLUMNS) == want


def hash_of(source):
    return len(source or "") + sum(map(ord, source or ""))


def test_shares_are_exact_for_large_counts():
    import numpy as np

    rng = random.Random(1)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(500)]
    count = [rng.randrange(0, t + 1) for t in total]
    assert sd.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(count, total)]
