"""Percentiles of very large numeric columns per group, from partial results that combine (problem 1).

Values are reduced to counts per (group, value): the state. States of files, days or months add up, so the
percentiles of the whole come from the partial states alone. With ``rel_error`` above zero a value is replaced by
the representative of its logarithmic bucket, so a state holds a bounded number of rows per group whatever the data
and each percentile lies within that relative error of the exact nearest-rank one; with zero it is exact.

The percentiles are read from cumulative frequencies: the state is sorted by range over (group, value), each
partition sums its counts by a window, the sums of the partitions before it are added, and the first value that
reaches the target rank is taken. A group may span any number of partitions, so no group is too large for a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def representative(value: Column, rel_error: float) -> Column:
    """The value itself, or its bucket's representative: within ``rel_error`` of the value, and monotone in it."""
    value = value.cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    if not rel_error:
        return value
    gamma = (1 + rel_error) / (1 - rel_error)
    size = F.abs(value)
    bucket = F.ceil(F.ln(size) / F.lit(math.log(gamma)))
    near = F.signum(value) * F.pow(F.lit(gamma), bucket) * F.lit(2 / (gamma + 1))
    return F.when((size == 0) | (size == float("inf")), value).otherwise(near)


def value_counts(df: DataFrame, groups: list[str], value: str, rel_error: float = 0.0) -> DataFrame:
    """The state: ``groups``, ``v`` and its count ``n``. Null and NaN values are left out; a null group is a group of its own.

    Groups can't be named ``v`` or ``n``; further columns don't matter, and neither does a value column of any name.
    """
    if {"v", "n"} & set(groups):
        raise ValueError("groups can't be named v or n")
    clean = df.where(F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double")))
    return clean.select(*[F.col(f"`{g}`") for g in groups], representative(F.col(f"`{value}`"), rel_error).alias("v")).groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n"))


def combine(state: DataFrame, groups: list[str]) -> DataFrame:
    """Adds up states (for instance united, or with fewer ``groups`` columns than they were counted by)."""
    return state.groupBy(*groups, "v").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], basis_points: list[int]) -> DataFrame:
    """``groups``, ``n`` and ``p<basis points>`` per group: the smallest value whose cumulative count reaches
    ``ceil(n * basis points / 10000)`` (at least 1). Groups without values have no row; ties are one value."""
    g = F.struct(*groups)
    ranged = state.select(g.alias("g"), "v", "n").repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id())
    # the partition numbers must be the same for the sums and for the offsets, even if an executor is lost between them
    ranged = cut(ranged)
    # one row per partition and group that meet: at most partitions + groups
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("s"))
    by_group = Window.partitionBy("g")
    offsets = sums.select("g", "part", F.coalesce(F.sum("s").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(by_group).alias("total"))
    running = ranged.withColumn("here", F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = running.join(offsets, ["g", "part"]).withColumn("reached", F.col("here") + F.col("before"))
    target = lambda bp: F.greatest(F.lit(1), F.expr(f"({int(bp)} * total + 9999) div 10000"))
    picks = [F.min(F.when(F.col("reached") >= target(bp), F.col("v"))).alias(f"p{bp}") for bp in basis_points]
    return placed.groupBy("g").agg(F.max("total").alias("n"), *picks).select(*[F.col(f"g.{c}").alias(c) for c in groups], "n", *[f"p{bp}" for bp in basis_points])
