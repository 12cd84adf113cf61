"""Period medians, gap filling, smoothing and index factors over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def period_medians(df: DataFrame, by: list[str], period: str, field: str, least: int = 1) -> DataFrame:
    """``by, period, n, median`` of periods with at least ``least`` values."""
    v = df.where(F.col(field).isNotNull() & F.col(period).isNotNull())
    return v.groupBy(*by, period).agg(F.count(F.lit(1)).alias("n"), F.median(field).alias("median")).where(F.col("n") >= least)


def month_spine(df: DataFrame, by: list[str], month: str) -> DataFrame:
    """Every month between the first and last of each group, as text YYYY-MM."""
    d = F.to_date(F.concat(F.col(month), F.lit("-01")))
    ends = df.groupBy(*by).agg(F.min(d).alias("a"), F.max(d).alias("b"))
    months = ends.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("__d"))
    return months.select(*by, F.date_format("__d", "yyyy-MM").alias(month))


def interpolate(df: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of nulls along ``at`` (a number), the nearest known value at both ends."""
    w = Window.partitionBy(*by).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("x"), F.col(value).alias("y")))
    p, n = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    got = df.withColumns({"__p": p, "__n": n})
    line = F.col("__p.y") + (F.col("__n.y") - F.col("__p.y")) * F.try_divide(F.col(at) - F.col("__p.x"), F.col("__n.x") - F.col("__p.x"))
    return got.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__p").isNull(), F.col("__n.y")).when(F.col("__n").isNull(), F.col("__p.y")).otherwise(line)).drop("__p", "__n")


def smooth(df: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Three-point smoothing from left to right in which each point sees its left neighbour smoothed; the ends stay.

    A group's periods (hundreds, not data rows) are folded in one array expression.
    """
    arr = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, value))).alias("s"))
    y = F.transform("s", lambda p: p[value])
    step = lambda acc, i: F.concat(acc, F.array(F.when((i == 0) | (i == F.size("s") - 1), y[i]).otherwise((F.element_at(acc, -1) + y[i] + y[i + 1]) / 3)))
    folded = F.aggregate(F.sequence(F.lit(0), F.size("s") - 1), F.array().cast("array<double>"), step)
    pairs = F.arrays_zip(F.col("s").alias("s"), folded.alias("f"))
    return arr.select(*by, F.explode(pairs).alias("z")).select(*by, F.col("z.s")[at].alias(at), F.col("z.s")[value].alias(value), F.col("z.f").alias(out))


def to_first(df: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Each value over the group's first."""
    return df.withColumn(out, F.try_divide(F.col(value), F.first(value).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def to_last(df: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """The group's last value over each: the factor that brings a value to the last period."""
    return df.withColumn(out, F.try_divide(F.last(value).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col(value)))


def month_number(month: Column) -> Column:
    """Months since year 0 of a text YYYY-MM."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def resolution(df: DataFrame, by: list[str], date: str, field: str, least: int = 5) -> DataFrame:
    """``M``, ``Q`` or ``Y`` per group: the finest whose share of thin periods (under ``least`` values) is allowed (2/12, 1/4)."""
    v = df.where(F.col(field).isNotNull() & F.col(date).isNotNull())

    def thin(part: str, name: str) -> DataFrame:
        n = v.groupBy(*by, F.date_trunc(part, date).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(*by).agg(F.avg((F.col("n") < least).cast("double")).alias(name))

    got = thin("month", "thin_m").join(thin("quarter", "thin_q"), by)
    return got.withColumn("resolution", F.when(F.col("thin_m") <= 2 / 12, "M").when(F.col("thin_q") <= 1 / 4, "Q").otherwise("Y"))


def time_index(df: DataFrame, by: list[str], month: str, field: str, least: int = 5) -> DataFrame:
    """``by, month, median, filled, factor``: monthly medians, gaps interpolated, and the factor to the last month."""
    med = period_medians(df, by, month, field, least)
    spine = month_spine(med, by, month)
    whole = spine.join(med.drop("n"), [*by, month], "left").withColumn("__m", month_number(F.col(month)))
    return to_last(interpolate(whole, by, "__m", "median", "filled"), by, "__m", "filled", "factor").drop("__m")


def adjust(df: DataFrame, index: DataFrame, by: list[str], month: str, field: str, out: str) -> DataFrame:
    """``field`` times its month's factor; unchanged where there is none."""
    return df.join(index.select(*by, month, "factor"), [*by, month], "left").withColumn(out, F.col(field) * F.coalesce("factor", F.lit(1.0)))


def differences(df: DataFrame, by: list[str], order: list[str], field: str, weights: list[float], out: str) -> DataFrame:
    """A weighted sum of a value and those before it (``weights[0]`` for itself); null where there are too few."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.col(field) * weights[0]
    for k, d in enumerate(weights[1:], 1):
        total = total + F.lag(field, k).over(w) * d
    return df.withColumn(out, total)


def difference_weights(m: int) -> list[float]:
    """Weights of order ``m`` that sum to 0 with squares that sum to 1: the first is sqrt(m / (m + 1)), the others are equal."""
    first = (m / (m + 1)) ** 0.5
    return [first] + [-first / m] * m
