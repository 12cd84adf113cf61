"""Ranks, quantile and fixed bins, pivots of top rows, extremes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import groups
from plumbline.operators.skew import null_safe_join
from plumbline.session import cut


def rank_share(df: DataFrame, by: list[str], field: str, out: str) -> DataFrame:
    """The average rank over the group's count (ties share their mean rank); null stays null.

    Ranks are worked out on the counts of distinct values and joined back.
    """
    n = df.where(F.col(field).isNotNull()).groupBy(*by, field).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy(field).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = (upto - (F.col("__n") - 1) / 2) / F.sum("__n").over(Window.partitionBy(*by))
    return null_safe_join(df, n.withColumn(out, share).drop("__n"), [*by, field], "left")


def group_ids(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """A dense number per distinct key, in key order (nulls first).

    The distinct keys are sorted by range; each partition numbers its own, after as many as there are before it.
    """
    keys = cut(df.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()))
    before = keys.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = before.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = keys.withColumn(out, F.row_number().over(Window.partitionBy("__p").orderBy(*by))).join(before, "__p")
    return null_safe_join(df, numbered.withColumn(out, F.col(out) + F.col("__before")).drop("__p", "__before"), by)


def share_of_group(df: DataFrame, by: list[str], field: str, out: str) -> DataFrame:
    return groups.with_aggregates(df, by, __all=F.sum(field)).withColumn(out, F.try_divide(F.col(field), F.col("__all"))).drop("__all")


def quantile_edges(df: DataFrame, field: str, n: int, by: list[str] | None = None) -> DataFrame:
    """Distinct edges of ``n`` quantile bins (linear interpolation), one row per group."""
    probs = [i / n for i in range(n + 1)]
    return df.where(F.col(field).isNotNull()).groupBy(*(by or [])).agg(F.array_distinct(F.percentile(field, probs)).alias("edges"))


def place_in(value: Column, edges: Column) -> Column:
    """The 1-based right-closed bin of a value between ascending edges (the lowest value is in bin 1); null outside."""
    above = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNull() | (value < F.element_at(edges, 1)) | (value > F.element_at(edges, -1)), None).otherwise(F.greatest(F.lit(1), above))


def quantile_bins(df: DataFrame, field: str, n: int, out: str, by: list[str] | None = None) -> DataFrame:
    """The quantile bin of each row within its group. Edges are one row per group, joined back."""
    e = quantile_edges(df, field, n, by)
    got = null_safe_join(df, e, by, "left") if by else df.crossJoin(F.broadcast(e))
    return got.withColumn(out, place_in(F.col(field), F.col("edges"))).drop("edges")


def fixed_bins(value: Column, edges: list[float]) -> Column:
    """Right-closed bins between given edges, the lowest edge included."""
    return place_in(value, F.array(*[F.lit(float(e)) for e in edges]))


def slice_label(value: Column, size: float) -> Column:
    """``floor(x / size) * size`` and the next slice as text ``a - b``."""
    low = F.floor(value / size) * F.lit(size)
    return F.when(value.isNotNull(), F.concat(low.cast("long").cast("string"), F.lit(" - "), (low + size).cast("long").cast("string")))


def top_pivot(df: DataFrame, key: str, order: list[Column], n: int, fields: list[str]) -> DataFrame:
    """The first ``n`` rows per key as columns ``<field>_1 .. <field>_n``; one aggregation, no pivot scan."""
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n)
    return r.groupBy(key).agg(*[F.max(F.when(F.col("__r") == i, F.col(f))).alias(f"{f}_{i}") for i in range(1, n + 1) for f in fields])


def largest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order (partial top-k in every task)."""
    return df.orderBy(*order).limit(n)


def extremes(df: DataFrame, field: str, unique: str, n: int, low: float, high: float) -> DataFrame:
    """Rows below ``low`` or above ``high``, and the ``n`` smallest and largest, each once."""
    seen = df.where(F.col(field).isNotNull())
    ends = largest(seen, [F.asc(field), F.asc(unique)], n).union(largest(seen, [F.desc(field), F.asc(unique)], n))
    return ends.union(seen.where((F.col(field) < low) | (F.col(field) > high))).dropDuplicates([unique])


def first_hit(df: DataFrame, by: str, order: list[str], keep: list[str]) -> DataFrame:
    """``keep`` of the row with the smallest ``order`` per key, by a partially aggregated minimum."""
    b = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("__b")
    return df.groupBy(by).agg(b).select(by, *[F.col(f"__b.{c}").alias(c) for c in keep])


def refine_clusters(df: DataFrame, base: list[str], numeric: list[str], least: int, out: str) -> DataFrame:
    """Cluster labels: the ``base`` values joined by ``_``, then per numeric field split by quantiles where all parts stay large.

    In a cluster of at least ``least`` rows, five bins are made if each has ``least`` rows or more; if not, the field
    leaves the cluster whole (smaller cuts are not tried). Every field is two aggregations over all clusters at once.
    """
    label = F.concat_ws("_", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in base])
    df = df.withColumn(out, label)
    for f in numeric:
        binned = quantile_bins(df, f, 5, "__bin", [out])
        per = binned.groupBy(out, "__bin").agg(F.count(F.lit(1)).alias("n"))
        fit = per.groupBy(out).agg(F.sum("n").alias("all"), F.min(F.when(F.col("__bin").isNotNull(), F.col("n"))).alias("small"), F.count("__bin").alias("k"))
        fit = fit.select(out, ((F.col("all") >= least) & (F.col("small") >= least) & (F.col("k") > 1)).alias("__fit"))
        binned = binned.join(fit, out)
        df = binned.withColumn(out, F.when(F.col("__fit"), F.concat_ws("_", F.col(out), F.coalesce(F.col("__bin").cast("string"), F.lit("0")))).otherwise(F.col(out))).drop("__bin", "__fit")
    return df
