"""Running totals and row numbers over a whole table without putting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permlens.session import written


def ordered_parts(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """The table range-partitioned by group and order and written, with the number of the part each row is in: the parts follow each other
    in that order, and a large group spans as many of them as it needs. Written, so that the numbers stay when a task is run again."""
    return written(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def running_totals(df: DataFrame, group: list[str], order: list[str | Column], amounts: dict[str, Column]) -> DataFrame:
    """The sums of amounts up to and including each row, per group in the given order, as columns of the given names. Each part is summed on
    its own and shifted by the totals of the parts before it."""
    names = list(amounts)
    parts = ordered_parts(df.withColumns({f"_amount_{n}": c for n, c in amounts.items()}), group, order)
    totals = parts.groupBy("_part", *group).agg(*[F.sum(f"_amount_{n}").alias(f"_sum_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", *group, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in names])
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"_upto_{n}": F.sum(f"_amount_{n}").over(within) for n in names}).alias("a")
    match = F.col("a._part") == F.col("b._part")
    for g in group:
        match = match & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = summed.join(shifts.alias("b"), match)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"_upto_{n}") + F.col(f"_shift_{n}")).cast("bigint").alias(n) for n in names])


def running_total(df: DataFrame, group: list[str], order: list[str | Column], amount: Column, name: str) -> DataFrame:
    return running_totals(df, group, order, {name: amount})


def number_rows(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """1-based row numbers in the given order within each group."""
    return running_total(df, group, order, F.lit(1), name)
