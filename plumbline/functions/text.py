"""Text helpers: boolean tokens, slugs, number formats, column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts for true, false and missing.
TRUE_WORDS = ["true", "t", "1", "y", "yes"]
FALSE_WORDS = ["false", "f", "0", "n", "no"]
MISSING_WORDS = ["none", "nan", "null", "na", "n/a", "-", "unknown"]


def to_bool(c: Column, kind: T.DataType, missing: bool = False) -> Column:
    """Booleans from tokens, numbers or booleans. Missing gives ``missing``, blank false, any other text true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(missing))
    if isinstance(kind, T.NumericType):
        return F.when(c.isNull() | F.isnan(c.cast("double")), missing).otherwise(c != 0)
    s = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(s.isNull() | s.isin(MISSING_WORDS), missing).when(s.isin(TRUE_WORDS), True).when(s.isin([*FALSE_WORDS, ""]), False).otherwise(True)


def slug(c: Column) -> Column:
    """Lower case, everything but letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fancy(c: Column) -> Column:
    """Short number text: 1.23B, 1.23M, 12.3K by size; small numbers with one decimal; null stays."""
    a = F.abs(c)
    short = lambda f, unit: F.concat(F.format_string("%.1f", c / F.lit(f)), F.lit(unit))
    return F.when(c.isNull(), None).when(a >= 1e9, short(1e9, "B")).when(a >= 1e6, short(1e6, "M")).when(a >= 1e3, short(1e3, "K")).otherwise(F.format_string("%.1f", c))


def clean_names(names: list[str]) -> list[str]:
    """Column names of letters, digits and underscores; names that collide get ``_1``, ``_2`` in order."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"\W+", "_", n.strip()).strip("_") or "column"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def mostly_numeric(df: DataFrame, field: str, share: float = 0.95) -> DataFrame:
    """``numeric``: whether at least ``share`` of the non-null texts of ``field`` are numbers (one row)."""
    c = F.col(field)
    return df.agg(F.coalesce(F.avg(F.when(c.isNotNull(), c.try_cast("double").isNotNull().cast("double"))) >= share, F.lit(False)).alias("numeric"))
