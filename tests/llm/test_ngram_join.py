import itertools
import random
from collections import defaultdict

import numpy as np

from permlens.llm import ngram_join as nj
from permlens.llm.common import WordNumbers
from permlens.llm.components import components
from tests.llm.conftest import key, passage, rows_of


def brute(rows, percent=90, n=3):
    """doc_id, n_shingles, component_id by comparing all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    nodes = [(("id", i) if i is not None else ("text", t), shingles(t)) for i, t in rows]
    up = {x: x for x, _ in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (x, s), (y, t) in itertools.combinations(nodes, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            up[root(x)] = root(y)
    groups = defaultdict(list)
    for x in up:
        groups[root(x)].append(x)
    least = {r: min((i for kind, i in members if kind == "id"), default=None) for r, members in groups.items()}
    return sorted(((i, len(s), least[root(x)]) for (i, _), (x, s) in zip(rows, nodes)), key=key)


def near(rng, words, edits):
    words = words[:]
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows_equal_brute_force(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(nj.linked(odd), "doc_id", "n_shingles", "component_id") == brute(rows)
    assert nj.linked(none).count() == 0


def test_groups_of_near_copies_equal_brute_force_in_one_task_and_in_blocks(spark):
    rng = random.Random(5)
    texts = []
    for g, size in enumerate((60, 25, 3, 2)):
        base = passage(100 + g, (60, 150, 40, 400)[g]).split()
        texts += [near(rng, base, rng.randint(0, 4)) for _ in range(size)]
    texts += [passage(500 + i, rng.randint(1, 40)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent, n, block in ((90, 3, nj.BLOCK_TOKENS), (90, 3, 700), (80, 5, 2000)):
        assert rows_of(nj.linked(docs, percent, n, block_tokens=block), "doc_id", "n_shingles", "component_id") == brute(rows, percent, n)


def test_rare_tokens_bring_all_links_together(spark, monkeypatch):
    """Also where most of a text is quoted from passages that many others quote, sets of few words, and a coarse order of tokens."""
    rng = random.Random(8)
    quoted = [passage(700 + i, 60) for i in range(3)]
    texts = [" ".join([passage(800 + i, rng.randint(0, 30)), *rng.sample(quoted, rng.randint(1, 3))]) for i in range(40)]
    texts += [near(rng, texts[rng.randrange(40)].split(), rng.randint(0, 6)) for _ in range(60)] + [passage(600 + i % 5, rng.randint(1, 6)) for i in range(25)]
    texts += [near(rng, passage(900, 200).split(), rng.randint(0, 8)) for _ in range(30)] + ["", None, "one", "one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 80, 5)
    for bits, sample, block in ((24, 4000, nj.BLOCK_TOKENS), (8, 20, 1500)):
        monkeypatch.setattr(nj, "ORDER_BITS", bits)
        monkeypatch.setattr(nj, "ORDER_DOCS", sample)
        assert rows_of(nj.linked(docs, 80, 5, block_tokens=block, rare=True), "doc_id", "n_shingles", "component_id") == want
    assert len({r[2] for r in want}) < len(want) - 50


def test_sets_that_link_share_a_part():
    rng = random.Random(1)
    numbers = WordNumbers()
    for percent in (90, 80):
        sizes = nj.Sizes(percent)
        for _ in range(300):
            base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(3, 120))]
            a, b = (nj.shingles(near(rng, base, rng.randint(0, 3)), numbers) for _ in range(2))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(nj.part_signatures(a, sizes)) & set(nj.part_signatures(b, sizes))


def test_one_document_of_each_group_stays_with_its_columns(odd, none):
    kept = nj.representatives(odd)
    assert kept.columns == odd.columns and nj.representatives(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = {(i, t) for (i, t) in rows if not (t or "").split() or any(d == i and c == i for d, _, c in brute(rows)) and i is not None}
    want |= {(None, passage(3))}  # linked with nothing, and without an id
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


def test_different_texts_of_one_id_are_one_document(spark):
    t = [passage(900 + i, 40) for i in range(8)]
    rows = [(9, t[0]), (9, t[1]), (3, t[1]), (20, t[0]), (7, t[2]), (7, ""), (5, t[2]), (11, t[3]), (11, t[4]), (12, t[4]), (12, t[5]), (10, t[5]), (30, None), (30, t[6]), (31, t[7]), (31, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(nj.linked(docs), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows) and {(9, 3), (20, 3), (7, 5), (11, 10)} <= {(d, c) for d, _, c in got}
    want = [(3, t[1]), (5, t[2]), (7, ""), (10, t[5]), (30, None), (30, t[6]), (31, t[7]), (31, " ")]
    assert rows_of(nj.representatives(docs), "doc_id", "text") == sorted(want, key=key)


def test_every_long_is_an_id(spark):
    t = [passage(950 + i, 40) for i in range(6)]
    most, least = 2**63 - 1, -(2**63)
    rows = [(most, t[0]), (most - 1, t[0]), (2**62, t[1]), (None, t[1]), (2**62 + 7, t[2]), (least, t[3]), (-5, t[3]), (None, t[4]), (None, t[4]), (most - 2, t[5]), (most - 3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(nj.linked(docs), "doc_id", "n_shingles", "component_id") == brute(rows)
    want = [(most - 1, t[0]), (2**62, t[1]), (2**62 + 7, t[2]), (least, t[3]), (None, t[4]), (most - 2, t[5]), (most - 3, None), (None, "")]
    assert rows_of(nj.representatives(docs), "doc_id", "text") == sorted(want, key=key)


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    ring = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + ring + [(5, 5), (999, 999)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {200 + i: 200 for i in range(1, 7)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


