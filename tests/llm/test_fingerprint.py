import functools
import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash

from permlens.llm import fingerprint as fp
from tests.llm.conftest import key, passage, rows_of


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return (a & b).total() / max(1, (a | b).total())


MASK = 2**64 - 1


def scramble(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def print_of(text, samples=64):
    """A text's fingerprint word by word, without the operator's code."""
    f = np.float32
    seeds = [np.array([scramble(8 * s + i + 1) for s in range(samples)], np.uint64) for i in range(2)]
    best, value = np.full(samples, np.inf), np.zeros(samples, np.int64)
    halves = lambda h: ((p.astype(f) + f(0.5)) * f(2.0**-32) for p in ((h & np.uint64(2**32 - 1)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)))
    for word, n in Counter(text.encode().split()).items():
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        x, y = (scrambled(h ^ s) for s in seeds)
        (u, v), (w, q) = halves(x), halves(y)
        most = f(1 - 2.0**-24)
        r, log_c = -np.log(np.minimum(u * v, most)), np.log(-np.log(np.minimum(w * q, most)))
        b = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(f) * f(2.0**-24)
        t = np.floor(np.log(f(n)) / r + b)
        claim = log_c - r * (t - b) - r if n > 1 else log_c + r * b - r
        own = (((x + t.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(48)).astype(np.int64)
        wins = (claim < best) | (claim == best) & (own < value)
        best, value = np.where(wins, claim, best), np.where(wins, own, value)
    return "".join(f"{v:04x}" for v in value) if np.isfinite(best[0]) else ""


def scrambled(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def alike(a, b):
    return float(np.mean([a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)])) if a and b else float(a == b)


def brute(rows):
    out = []
    for k, (i, t, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = (printed(x) for x in (t, e, following))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=key)


@functools.cache
def printed(text):
    return print_of(text)


def test_odd_rows_and_neighbours_across_tasks(spark, odd, none):
    ranked = odd.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    rows = sorted(((r.doc_id, r.text, r.h) for r in ranked), key=lambda r: (2**63 if r[0] is None else r[0], r[2], r[1].encode()), reverse=True)
    columns = [c for c, _ in fp.RESULT]
    assert rows_of(fp.compare_edited(odd), *columns) == brute(rows)  # four range partitions
    one = odd.where("doc_id = 4")
    assert rows_of(fp.compare_edited(one), *columns) == brute([r for r in rows if r[0] == 4])
    assert fp.compare_edited(none).count() == 0 and fp.fingerprints(none).count() == 0
    assert {(r.doc_id, r.fingerprint) for r in fp.fingerprints(odd).collect()} == {(r[0], r[3]) for r in brute(rows)}


def test_equal_samples_estimate_the_weighted_similarity(monkeypatch):
    """Every pair has its own often repeated word, so that the errors of the pairs are independent."""
    monkeypatch.setattr(fp, "CACHE_WORDS", 1000)
    monkeypatch.setattr(fp, "BLOCK_PAIRS", 1000)
    rng = random.Random(2)
    sampler, errors = fp.Sampler(4096), []
    for i in range(40):
        words = passage(i, 120).split() + [f"often{i}"] * rng.randint(1, 30)
        other = words[: rng.randint(10, 120)] + passage(900 + i, 50).split() + [f"often{i}"] * rng.randint(0, 30)
        a, b = " ".join(words), " ".join(other)
        x, y = sampler.prints([a, b])
        errors.append(fp.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.004 and np.std(errors) < 0.015


def test_prints_do_not_depend_on_what_a_task_saw_before(monkeypatch):
    texts = [passage(i, 300) for i in range(20)] + ["", passage(99, 5000), " ".join(f"w{i}" for i in range(9000)), passage(3, 300)]
    want = [fp.as_text(fp.Sampler().prints([t])[0]) for t in texts]
    for terms, block in ((150_000, 20_000), (1000, 400), (300, 100)):
        monkeypatch.setattr(fp, "CACHE_WORDS", terms)
        monkeypatch.setattr(fp, "BLOCK_PAIRS", block)
        assert [fp.as_text(p) for p in fp.Sampler().prints(texts)] == want
    assert want[3] == want[-1] and want[20] == "" and fp.likeness(None, None) == 1.0 and fp.likeness(None, fp.Sampler().prints(["a"])[0]) == 0.0
