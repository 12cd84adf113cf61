"""Grouped statistics, fills, sparse categories, profiles.

Group statistics are one partially aggregated pass each; exact percentiles are Spark's ``percentile`` (a count per
distinct value), which matches linear interpolation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.skew import null_safe_join


def numeric_stats(df: DataFrame, by: list[str], field: str, name: str) -> DataFrame:
    """``<name>_mean, _median, _std, _min, _max, _sum, _count, _cv, _p25, _p75, _iqr`` per group; nulls and NaN left out."""
    c = F.col(f"`{field}`").cast("double")
    c = F.when(~F.isnan(c), c)
    got = df.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.count(c).alias("count"), F.percentile(c, [0.25, 0.5, 0.75]).alias("q")
    )
    got = got.withColumns({"cv": F.try_divide("std", "mean"), "p25": F.col("q")[0], "median": F.col("q")[1], "p75": F.col("q")[2], "iqr": F.col("q")[2] - F.col("q")[0]})
    return got.select(*by, *[F.col(s).alias(f"{name}_{s}") for s in ("mean", "median", "std", "min", "max", "sum", "count", "cv", "p25", "p75", "iqr")])


def category_stats(df: DataFrame, by: list[str], field: str, name: str) -> DataFrame:
    """``<name>_mode`` (most frequent, then smallest), ``_mode_frac, _nunique, _entropy`` (natural log); nulls left out."""
    n = df.where(F.col(field).isNotNull()).groupBy(*by, F.col(field).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    s = n.groupBy(*by).agg(
        F.sum("__n").alias("t"), F.max("__n").alias("m"), F.count(F.lit(1)).alias(f"{name}_nunique"), F.sum(F.col("__n") * F.ln("__n")).alias("l"), F.min(F.struct((-F.col("__n")).alias("k"), "__v")).alias("b")
    )
    return s.select(*by, F.col("b.__v").alias(f"{name}_mode"), (F.col("m") / F.col("t")).alias(f"{name}_mode_frac"), f"{name}_nunique", (F.ln("t") - F.col("l") / F.col("t")).alias(f"{name}_entropy"))


def masked(df: DataFrame, count: str, fields: list[str], least: int) -> DataFrame:
    """``fields`` only where ``count`` reaches ``least``."""
    return df.withColumns({f: F.when(F.col(count) >= least, F.col(f)) for f in fields})


def with_aggregates(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with its group's aggregates as columns: one partially aggregated pass joined back, no group in one task."""
    return null_safe_join(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()]), by)


def repeated(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``out``: whether the combination of ``columns`` occurs more than once; false where one of them is null."""
    n = df.where(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return df.join(n, columns, "left").withColumn(out, F.col("__n").isNotNull()).drop("__n")


def deviation(df: DataFrame, by: list[str], field: str) -> DataFrame:
    """``by, n, median, cod`` per group: 100 x mean absolute deviation from the median over the median.

    Median 0: 0 if all values are 0, else infinite. The median comes from one aggregate and is joined back, so no
    group is gathered in one task.
    """
    vals = df.where(F.col(field).isNotNull())
    med = vals.groupBy(*by).agg(F.median(field).alias("median"))
    dev = (vals.join(med, by) if by else vals.crossJoin(F.broadcast(med))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("median").alias("median"), F.avg(F.abs(F.col(field) - F.col("median"))).alias("d"))
    cod = F.when(F.col("median") != 0, 100 * F.try_divide("d", "median")).when(F.col("d") == 0, 0.0).otherwise(float("inf"))
    return dev.select(*by, "n", "median", cod.alias("cod"))


def fill_by_group(df: DataFrame, by: list[str], field: str, how: str, only: Column | None = None) -> DataFrame:
    """Fills nulls of ``field`` in rows where ``only`` holds by ``zero, unknown, none, false, mean, median, min, max, mode``
    of the group's rows; a group without values stays null."""
    c = F.col(f"`{field}`")
    constant = {"zero": F.lit(0), "unknown": F.lit("UNKNOWN"), "none": F.lit("NONE"), "false": F.lit(False)}
    base = df if only is None else df.where(only)
    if how in constant:
        filled = df.withColumn("__f", constant[how])
    else:
        if how == "mode":
            n = base.where(c.isNotNull()).groupBy(*by, c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
            one = n.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("k"), "__v")).alias("__b")).select(*by, F.col("__b.__v").alias("__f"))
        else:
            one = base.groupBy(*by).agg({"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how](c).alias("__f"))
        filled = null_safe_join(df, one, by, "left")
    miss = c.isNull() if only is None else c.isNull() & F.coalesce(only, F.lit(False))
    return filled.withColumn(field, F.when(miss, F.col("__f")).otherwise(c)).drop("__f")


def collapse_sparse(universe: DataFrame, sales: DataFrame, field: str, least_universe: int, least_sales: int, other: str = "OTHER") -> tuple[DataFrame, DataFrame]:
    """Both tables with rare categories replaced by ``other``: those under either minimum, if there are at least two.

    The same mapping serves both; null is never replaced.
    """
    u = universe.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("u"))
    s = sales.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("s"))
    rare = u.join(s, field, "full").where((F.coalesce("u", F.lit(0)) < least_universe) | (F.coalesce("s", F.lit(0)) < least_sales)).select(field)
    rare = rare.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("__k >= 2").select(field, F.lit(True).alias("__rare"))
    swap = lambda df: df.join(rare, field, "left").withColumn(field, F.when(F.col("__rare"), other).otherwise(F.col(field))).drop("__rare")
    return swap(universe), swap(sales)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``field, kind, n, non_null, non_zero, distinct_values`` (zero: 0, false, blank; NaN is null). One pass."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        num = isinstance(f.dataType, T.NumericType)
        v = F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
        zero = (v == 0) if num else ~v if isinstance(f.dataType, T.BooleanType) else (v == "") if isinstance(f.dataType, T.StringType) else F.lit(False)
        kind = "number" if num else "boolean" if isinstance(f.dataType, T.BooleanType) else "date" if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)) else "text"
        cells.append((f.name, kind, F.count(v), F.count(F.when(v.isNotNull() & ~zero, 1)), v))
    # counts in one pass; distinct counts through one row per value, partially aggregated
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("v")) for n, _, _, _, v in cells])).alias("x")).select("x.*")
    distinct = flat.where("v is not null").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, (_, _, a, b, _) in enumerate(cells) for x in (a.alias(f"a{i}"), b.alias(f"b{i}"))])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.col("n"), F.col(f"a{i}").alias("non_null"), F.col(f"b{i}").alias("non_zero")) for i, (n, k, _, _, _) in enumerate(cells)])).alias("x")).select("x.*")
    return rows.join(distinct, "field", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def representation(sales: DataFrame, universe: DataFrame, fields: list[str]) -> DataFrame:
    """``field`` with share non-zero, mean and median in both tables."""

    def side(df: DataFrame, s: str) -> DataFrame:
        c = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in fields}
        one = df.agg(*[x for f in fields for x in (F.avg(F.coalesce((c[f] != 0).cast("double"), F.lit(0.0))).alias(f"z_{f}"), F.avg(c[f]).alias(f"a_{f}"), F.median(c[f]).alias(f"m_{f}"))])
        return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"z_{f}").alias(f"{s}_non_zero"), F.col(f"a_{f}").alias(f"{s}_mean"), F.col(f"m_{f}").alias(f"{s}_median")) for f in fields])).alias("x")).select("x.*")

    return side(sales, "sales").join(side(universe, "universe"), "field")
