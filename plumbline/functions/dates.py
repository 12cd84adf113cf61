"""Date parts, periods and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(df: DataFrame, date: str, prefix: str) -> DataFrame:
    """``<prefix>_year, _month, _day, _quarter, _year_month`` (YYYY-MM) and ``_year_quarter`` (YYYYQn)."""
    d = F.col(date)
    return df.withColumns({
        f"{prefix}_year": F.year(d), f"{prefix}_month": F.month(d), f"{prefix}_day": F.dayofmonth(d), f"{prefix}_quarter": F.quarter(d),
        f"{prefix}_year_month": F.date_format(d, "yyyy-MM"), f"{prefix}_year_quarter": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
    })


def age_days(date: Column, valuation: str) -> Column:
    """Days from ``date`` to the valuation date (negative after it)."""
    return F.datediff(F.lit(valuation).cast("date"), date)


def building_age(year_built: Column, year: Column) -> Column:
    """Years since construction; 0 where the year is missing or not positive."""
    return F.when(year_built.isNull() | (year_built <= 0), 0).otherwise(year - year_built)


def in_range(date: Column, start: str, end: str) -> Column:
    """Whole days from ``start`` to ``end``, both included; null dates give null. The column stands alone, so the bounds reach the scan."""
    return (date >= F.lit(start).cast("date").cast("timestamp_ntz")) & (date < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def middle_day(period: Column, kind: str) -> Column:
    """The middle day of a period ``YYYY-MM`` (15th), ``YYYYQn`` (15th of its second month) or ``YYYY`` (1 July)."""
    if kind == "M":
        return F.make_date(F.substring(period, 1, 4).cast("int"), F.substring(period, 6, 2).cast("int"), F.lit(15))
    if kind == "Q":
        return F.make_date(F.substring(period, 1, 4).cast("int"), F.substring(period, 6, 1).cast("int") * 3 - 1, F.lit(15))
    return F.make_date(period.cast("int"), F.lit(7), F.lit(1))
