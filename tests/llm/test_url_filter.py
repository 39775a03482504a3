import random
import re

from pyspark.sql import functions as F

from permlens.llm import url_filter as uf
from permlens.llm.queries import URL_RULES
from tests.llm.conftest import key, rows_of


def brute(url, rules):
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


ODD = [None, "", "no scheme", "http://", "://", "http://COM/", "http://com", "https://x.com/a?b#c", "http://example.com/en/1", "http://EXAMPLE.com/en", "http://www.example.com/en/x", "http://a.www.example.com/en/",
       "http://notexample.com/en/", "http://x.net/es/", "http://x.net/ES/", "http://net/fr/1", "http://x.net?/es/", "http://x.net#/es/", "ftp://u@h.com:80/en/", "a://b://c.net/es/", "http://x.com./", "http://..com/", "http://é.com/\n/x", "http://x.com/" + "y" * 9000]


def test_odd_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(3, ODD[7]), (None, ODD[8])]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, HOST string, verdict int, key string")
    got = uf.judge(df, URL_RULES)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *brute(u, URL_RULES)) for i, u in rows), key=key)
    assert "key" in got.columns and uf.judge(df.limit(0), URL_RULES).count() == 0
    assert {(r.rule, r.verdict) for r in uf.judge(df, []).collect()} == {(None, "allow")}


def test_many_rules_and_hosts(spark, monkeypatch):
    rng = random.Random(6)
    name = lambda n: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, n)))
    rules = list({(h, p): (v, h, p) for v, h, p in ((rng.choice(["allow", "block"]), name(3), rng.choice(["/", "/a", "/a/b", ""])) for _ in range(60))}.values())
    urls = [(i, f"http://{name(4)}{rng.choice(['', '/', '/a', '/a/bc', '/ab?x'])}") for i in range(400)]
    pages = spark.createDataFrame([*urls, urls[0], (None, None)], "page_id long, url string")
    got = uf.judge(pages, rules)
    monkeypatch.setattr(uf, "MAX_LEVEL_BYTES", 1)  # too many rules for a constant
    assert rows_of(uf.judge(pages, rules), "page_id", "host", "path", "rule", "verdict") == rows_of(got, "page_id", "host", "path", "rule", "verdict")
    assert uf.judge(pages.limit(0), rules).count() == 0
    got = got.where("page_id is not null").distinct()
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted((i, *brute(u, rules)) for i, u in urls)


def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.where("xxhash64(key) % 7 = 0").unionByName(keys.limit(3)).unionByName(spark.createDataFrame([(None,)], "key string"))
    cascade = uf.build_cascade(listed, keys.unionByName(keys))
    assert len(cascade.levels) > 2  # false positives were met and encoded
    want = {r.key for r in listed.collect()} - {None}
    assert {r.key for r in keys.where(cascade.contains(F.col("key"))).collect()} == want
    plan = keys.withColumn("in", cascade.contains(F.col("key")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    monkeypatch.setattr(uf, "MAX_LEVEL_BYTES", 10)  # beyond the bound: the same answers by a join
    marked = uf.build_cascade(listed, keys).mark(keys, "key", "in")
    assert {r.key for r in marked.where("in").collect()} == want and marked.count() == 6000
