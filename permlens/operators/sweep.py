"""Counting at points in time by a sweep over window boundaries: windows and times never meet in pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.operators.numbering import running_totals
from permlens.session import written

FIRST, LAST = -(2**62), 2**62  # before and after every time, in microseconds


def micros(time) -> F.Column:
    return F.unix_micros(F.col(time)) if isinstance(time, str) else F.unix_micros(time)


def counts_at(rows: DataFrame, asked: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """The asked rows (keys, as_of) with the sums of the amounts over the rows of equal keys whose window [valid_from, valid_to) holds as_of;
    a row without a boundary is open on that side, and without as_of all rows count. asked must be distinct, and its keys not null.

    Rows without a window are one sum per key. For the others every key's boundaries are put in order with the amounts that open and close
    there; running totals along them give what is open at each, and an asked time takes the totals of the last boundary up to it. Running
    totals are distributed, so one key may hold most of the rows."""
    windowed = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    always = rows.where(~windowed).groupBy(*keys).agg(*[F.sum(a).alias(f"_base_{a}") for a in amounts])
    spans = rows.where(windowed).groupBy(*keys, "valid_from", "valid_to").agg(*[F.sum(a).alias(a) for a in amounts])
    spans = written(spans.select(*keys, *amounts, F.coalesce(micros("valid_from"), F.lit(FIRST)).alias("_from"), F.coalesce(micros("valid_to"), F.lit(LAST)).alias("_to")), "spans")
    opening = spans.select(*keys, F.col("_from").alias("_time"), *[F.col(a).alias(f"_net_{a}") for a in amounts], *[F.col(a).alias(f"_all_{a}") for a in amounts])
    closing = spans.select(*keys, F.greatest("_from", "_to").alias("_time"), *[(-F.col(a)).alias(f"_net_{a}") for a in amounts], *[F.lit(0).alias(f"_all_{a}") for a in amounts])
    totals = [f"_{kind}_{a}" for kind in ("net", "all") for a in amounts]
    boundaries = opening.unionByName(closing).groupBy(*keys, "_time").agg(*[F.sum(t).alias(t) for t in totals]).withColumn("_kind", F.lit(0))
    times = asked.select(*keys, "as_of").join(spans.select(*keys).distinct(), keys, "left_semi")
    points = times.select(*keys, F.coalesce(micros("as_of"), F.lit(LAST)).alias("_time"), F.col("as_of").isNull().alias("_untimed"))
    points = points.withColumns({t: F.lit(0) for t in totals}).withColumn("_kind", F.lit(1))
    line = boundaries.withColumn("_untimed", F.lit(False)).unionByName(points)
    swept = running_totals(line, keys, ["_time", "_kind", "_untimed"], {f"{t}_upto": F.col(t) for t in totals}).where("_kind = 1")
    at = swept.select(*keys, "_time", "_untimed", *[F.when(F.col("_untimed"), F.col(f"_all_{a}_upto")).otherwise(F.col(f"_net_{a}_upto")).alias(f"_open_{a}") for a in amounts])
    asked_at = asked.withColumn("_time", F.coalesce(micros("as_of"), F.lit(LAST))).withColumn("_untimed", F.col("as_of").isNull())
    joined = asked_at.join(always, keys, "left").join(at, [*keys, "_time", "_untimed"], "left")
    summed = [reduce(lambda x, y: x + y, [F.coalesce(f"_{k}_{a}", F.lit(0)) for k in ("base", "open")]).alias(a) for a in amounts]
    return joined.select(*asked.columns, *summed)
