"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.session import BROADCAST_ROWS, is_small

SALTS = 16


def spread_join(few: DataFrame, many: DataFrame, on: list[str], identity: list[str], condition: Column | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of `few` (alias w) with `many` (alias i) on equal columns and a condition over the aliases. A small side (of at most
    max_rows rows, fewer for wide rows) is broadcast and the large one stays where it is. Otherwise both are shuffled, with every key of the large side spread over salts by the row's
    identity and the other side repeated for each salt, so no key is one task's work. That is asked for by a hint: a table written as Parquet
    may be far smaller than its rows, and the optimizer would broadcast it, repeated rows and all."""
    if is_small(few, max_rows):
        w, i, keys = F.broadcast(few).alias("w"), many.alias("i"), on
    else:
        salt = F.pmod(F.xxhash64(*identity), F.lit(SALTS)).cast("int")
        i = many.withColumn("_salt", salt).alias("i")
        w = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge").alias("w")
        keys = [*on, "_salt"]
    same = F.lit(True) if condition is None else condition
    for key in keys:
        same = same & (F.col(f"w.{key}") == F.col(f"i.{key}"))
    return w.join(i, same)
