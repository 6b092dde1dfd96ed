"""Positions of values in sorted tables, and permutations of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(queries: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """queries with lower and upper: the number of the key's table values below, and not above.

    One sorted pass over the union instead of a range join: rows of both sides stand in order
    within a key, and running counts of table rows are the bounds.
    """
    asked = queries.withColumn("side_", F.lit(1)).withColumn("in_", F.lit(0))
    held = table.select(key, value, *[F.lit(None).cast(t).alias(c) for c, t in queries.dtypes if c not in (key, value)], F.lit(0).alias("side_"), F.lit(1).alias("in_"))
    order = Window.partitionBy(key).orderBy(value)
    both = asked.unionByName(held)
    upto = F.sum("in_").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("in_").over(Window.partitionBy(key, value))
    return both.withColumns({"upper": upto, "same_": same}).where("side_ = 1").withColumn("lower", F.col("upper") - F.col("same_")).drop("side_", "in_", "same_")


def permute(values: Column, order: list[int]) -> Column:
    """values[order[0]], values[order[1]], ..."""
    return F.array(*[values[i] for i in order])


def inverse(order: list[int]) -> list[int]:
    return sorted(range(len(order)), key=order.__getitem__)


def ordered_cdf(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Share of the weight up to each row in the order of value."""
    run = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = df.groupBy(*keys).agg(F.sum(weight).alias("whole_"))
    return df.withColumn("sum_", F.sum(weight).over(run)).join(whole, keys).withColumn("cdf", F.col("sum_") / F.col("whole_")).drop("sum_", "whole_")
