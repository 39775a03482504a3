"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.session import written


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: a, b (whole numbers). Returns node, root (the smallest node reachable), one row per node that is not its own root. Every round hangs
    larger neighbours and then smaller ones on the smallest known node; the rounds needed grow with the logarithm of a component's
    longest path. Groupings combine before they shuffle and joins by node are split where one is hot, so a hub is no one task's work."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = written(edges, name), None
    while (state := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != seen:
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
