"""Operator 4: URL rules decided by Bloom filter cascades, with DataFrame functions only.

A cascade for a set of listed keys over a universe of keys: level 1 holds the listed keys; level 2 holds the keys of the universe that
level 1 reports wrongly; level 3 the listed keys that level 2 reports wrongly, and so on until a level reports none wrongly. For every
key of the universe the answer is then exact, and it is an expression over a few constant bit strings: no join, no shuffle.

Building reads the universe once to count it and once per odd level; only keys that pass the levels so far are made distinct, so the
universe itself is never shuffled. The bit strings are proportional to the listed keys. Their size is checked: a level beyond
MAX_LEVEL_BYTES is not put into the plan, and `mark` and `judge` use a shuffled join instead (same answers).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.llm import bloom
from permlens.llm.bloom import Level, reports
from permlens.llm.common import UPPER, hidden
from permlens.session import written

MAX_LEVEL_BYTES = 4 << 20
KEYS, FIRST = hidden("keys"), hidden("first")
DEEPER_RATE = 0.5  # false-positive rate of every level after the first


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)
    too_large: DataFrame | None = None  # the listed keys, where a level went beyond its bound

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed. A null key is not listed."""
        if self.too_large is not None:
            raise ValueError("the listed keys are beyond the bound of a filter: use mark()")
        answer = F.lit(False)
        for level in reversed(self.levels):
            answer = reports(level, key) & ~answer
        return F.coalesce(answer, F.lit(False))

    def mark(self, keys: DataFrame, column: str, out: str) -> DataFrame:
        """The rows with a boolean column `out`; by the filter, or by a join where the filter would be too large."""
        if self.too_large is None:
            return keys.withColumn(out, self.contains(F.col(column)))
        listed = self.too_large.select(F.col("key").alias(column), F.lit(True).alias(out))
        return keys.join(listed, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed: one column `key`; universe: one column `key`, which need not be distinct and holds every key that will be asked. Nulls are
    left out. No listed key: an empty cascade, which contains nothing."""
    listed = written(listed.select("key").where("key is not null").distinct(), "cascade-listed")
    n = listed.count()
    if not n:
        return Cascade()
    keys = universe.select("key").where("key is not null")
    total = max(1, keys.agg(F.approx_count_distinct("key")).first()[0])
    rate = min(DEEPER_RATE, math.sqrt(0.5) * n / total)  # then about as many wrong keys go down as are listed, or fewer
    cascade, wanted, count = Cascade(), listed, n
    others = keys
    while count:
        level = bloom.level(wanted, bloom.bits_for(count, rate), bloom.hashes_for(rate), len(cascade.levels) + 1, MAX_LEVEL_BYTES)
        if level is None:
            return Cascade(too_large=listed)
        cascade.levels.append(level)
        wrong = others.where(reports(level, F.col("key"))).distinct()
        if len(cascade.levels) == 1:
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = written(wrong, "cascade-wrong")
        others, wanted, count, rate = wanted, wrong, wrong.count(), DEEPER_RATE
    return cascade


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every rule that could fit the URL, longest first (host and path together; of equal ones that with the longer host): each run of
    whole labels at the host's end, with the path's beginnings of the lengths that rules have."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths])
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(starts, lambda s: s.isNotNull()), lambda s: F.struct((-F.length(h) - F.length(s)).alias("size"), (-F.length(h)).alias("labels"), F.concat(h, s).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda p: p["key"])


def _judged_by_join(judged: DataFrame, keys: Column, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same answers where the rules are too many for a constant: every URL's keys meet the rules by a shuffled join."""
    spark, row = judged.sparkSession, hidden("row")
    numbered = written(judged.withColumn(KEYS, keys).withColumn(row, F.monotonically_increasing_id()), "urls")
    listed = spark.createDataFrame([(host + path, v == "block") for v, host, path in rules], "key string, blocked boolean").groupBy("key").agg(F.max("blocked").alias("blocked"))
    asked = numbered.select(row, F.posexplode(KEYS).alias("at", "key"))
    first = asked.join(listed, "key").groupBy(row).agg(F.min(F.struct("at", "key", "blocked")).alias(FIRST))
    verdict = F.when(F.col(f"{FIRST}.blocked"), "block").otherwise("allow")
    return numbered.join(first, row, "left").withColumns({"rule": F.col(f"{FIRST}.key"), "verdict": verdict}).drop(KEYS, FIRST, row)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the rows. rules: (allow or block, host, path); a rule fits its host and all subdomains if the
    path starts with the rule's path; the longest wins. A key under both verdicts is blocked. Where no rule fits, the cascades list none
    of the URL's keys: rule null, verdict allow. Null URLs and URLs without `://` have an empty host and path and fit no rule with a
    host. Repeated rows are judged alike; columns of these names in the input are replaced; an empty table gives an empty one."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    judged = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")])
    judged = judged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if rules else F.array().cast("array<string>")
    universe = judged.select(F.explode(keys).alias("key"))
    cascades = {}
    for verdict in ("block", "allow"):
        own = [(host + path,) for v, host, path in rules if v == verdict]
        listed = spark.createDataFrame(own or [("",)], "key string").where(F.lit(bool(own)))
        cascades[verdict] = build_cascade(listed, universe)
    blocked, allowed = cascades["block"], cascades["allow"]
    if blocked.too_large is not None or allowed.too_large is not None:
        return _judged_by_join(judged, keys, rules)
    listed = F.transform(KEYS, lambda k: F.struct(k.alias("key"), blocked.contains(k).alias("blocked"), allowed.contains(k).alias("allowed")))
    judged = judged.withColumn(KEYS, keys).withColumn(FIRST, F.get(F.filter(listed, lambda k: k["blocked"] | k["allowed"]), F.lit(0)))
    verdict = F.when(F.col(f"{FIRST}.blocked"), "block").otherwise("allow")
    return judged.withColumns({"rule": F.col(f"{FIRST}.key"), "verdict": verdict}).drop(KEYS, FIRST)
