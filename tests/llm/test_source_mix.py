import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from permlens.llm import source_mix as sm
from tests.llm.conftest import passage, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levelled(sizes, weights=(5, 2, 1), most=3):
    """Targets by source in exact fractions, the excess shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = words - sum(most * sizes[s] for s in full)
        target = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        above = {s for s in free if target[s] >= most * sizes[s]}
        if not above:
            return target | {s: Fraction(most * sizes[s]) for s in full}
        full |= above
        if len(full) == len(names):
            return {s: Fraction(most * sizes[s]) for s in full}


def check(docs, **options):
    given = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in given:
        sizes[s] += n
    mix = sm.taken(sm.mixed(docs, **options)).collect()
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.source, r["size"]) for r in mix), key=order) == sorted(given, key=order)
    want, block = levelled(sizes), options.get("block_words", sm.BLOCK_WORDS)
    got = defaultdict(int)
    for r in mix:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source])) and 0 <= r.taken <= 3 * r["size"]
        assert all(0 <= e.start < e.stop <= r["size"] for e in r.extra) and r.passes + bool(r.extra) <= 3
        got[r.source] += r.taken
    return got, want, block, sizes


def test_odd_rows(odd, none):
    extra = odd.withColumnRenamed("row", "number").withColumnRenamed("node", "shard").withColumnRenamed("doc", "size")
    got, want, block, _ = check(extra)
    assert all(abs(got[s] - want[s]) <= 3 * block for s in want)
    assert sm.mixed(none).count() == 0 and rows_of(sm.mixed(odd), "doc_id", "passes") == rows_of(sm.mixed(odd.repartition(1)), "doc_id", "passes")
    empty = odd.where("text is null or trim(text) = ''")
    assert {(r.taken, r.target) for r in sm.taken(sm.mixed(empty)).collect()} == {(0, 0.0)}


def test_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(passage(i % 7, 40).split() * rng.randint(0, 12)), rng.choices(["a", "b", "c", "d", "e", None, "é", "tiny"], [300, 90, 20, 5, 50, 3, 8, 1])[0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({}, {"shard_words": 20_000, "block_words": 8}, {"shard_words": 3_000, "block_words": 1, "seed": "other"}):
        got, want, block, sizes = check(docs, **options)
        shards = -(-sum(sizes.values()) // options.get("shard_words", sm.SHARD_WORDS))
        for s in want:
            assert abs(got[s] - want[s]) <= 3 * block * shards + 1, (s, options)
            assert want[s] != 3 * sizes[s] or got[s] == 3 * sizes[s]
    first, second = (rows_of(sm.taken(sm.mixed(docs.repartition(n))), "doc_id", "taken") for n in (1, 7))
    assert first == second != rows_of(sm.taken(sm.mixed(docs, seed="z")), "doc_id", "taken")


def test_seats_go_to_the_highest_quotients(spark):
    """Against seats given one by one."""
    rng = random.Random(2)
    rows = []
    for group in range(12):
        votes = [rng.choice([1, 5, 17, 400, 1000, rng.randint(1, 3000)]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        rows += [(group, i, v, seats, sum(votes), len(votes), 10_000) for i, v in enumerate(votes)]
    names = ["g", "party", "votes", "seats", "total", "members", "most"]
    got = sm.apportioned(spark.createDataFrame(rows, names), ["g"], "party", "votes", "seats", "total", "members", "most", "won")
    want = []
    for group in range(12):
        own = [r for r in rows if r[0] == group]
        won = [0] * len(own)
        for _ in range(own[0][3]):
            won[max(range(len(own)), key=lambda i: (own[i][2] / (2 * won[i] + 1), -i))] += 1
        want += [(group, r[1], n) for r, n in zip(own, won)]
    assert rows_of(got, "g", "party", "won") == sorted(want)


def test_texts_of_the_mix(spark):
    rows = [(i, f"  {passage(i, 30 + i)}\n tail", "big" if i else "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = sm.mixed(docs, block_words=4)
    taken = {r.doc_id: r.taken for r in sm.taken(mix).collect()}
    words = defaultdict(int)
    for r in sm.texts(mix, docs).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in " ".join(rows[r.doc_id][1].split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_no_python_in_the_plan(spark, given):
    from permlens.llm import queries

    plan = queries.op13_source_mix(spark, given)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapPartitions|CartesianProduct|BroadcastNestedLoop", plan)
