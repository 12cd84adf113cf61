"""De-duplication: first row per key, dropping every repeated key, or aggregating repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.skew import null_safe_join

#: Aggregations by name, over a column.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "count": F.count, "nunique": F.count_distinct, "std": F.stddev_samp,
}


def order(sort_by: list) -> list[Column]:
    """``["a", ["b", "desc"]]`` as sort columns; nulls come last either way."""
    pairs = [(s, "asc") if isinstance(s, str) else tuple(s) for s in sort_by]
    return [F.desc_nulls_last(c) if how == "desc" else F.asc_nulls_last(c) for c, how in pairs]


def keep_first(df: DataFrame, subset: list[str], sort_by: list) -> DataFrame:
    """The first row of each ``subset`` key; ``sort_by`` should end in a unique column. Null keys are one key.

    Spark limits each task to one row per key before the shuffle (window group limit), so a hot key is no burden.
    """
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*subset).orderBy(*order(sort_by)))).where("__n = 1").drop("__n")


def drop_repeated(df: DataFrame, subset: list[str]) -> DataFrame:
    """Only rows whose key occurs once (null is a key). Keys are counted with partial sums, so a hot key is no burden."""
    once = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
    return null_safe_join(df, once, subset, "inner").drop("__n")


def collapse(df: DataFrame, subset: list[str], sort_by: list, agg: dict[str, dict]) -> DataFrame:
    """The first row per key, with columns of ``agg`` = ``{out: {"field", "op"[, "sort_by"]}}`` over all rows of the key.

    ``op`` is one of AGGREGATES, ``first`` or ``last`` (in the order of the entry's ``sort_by``). An output with the
    name of a column replaces it; the columns are made whether or not there are repeated keys.
    """
    firsts = keep_first(df, subset, sort_by)
    cols = []
    for out, e in agg.items():
        c = F.col(f"`{e['field']}`")
        if e["op"] in ("first", "last"):
            by = [(s, "asc") if isinstance(s, str) else tuple(s) for s in e.get("sort_by", sort_by)]
            # the smallest sort key; descending parts can't be told in a struct, so rows are ranked first
            rank = F.row_number().over(Window.partitionBy(*subset).orderBy(*order([list(x) for x in by])))
            df = df.withColumn(f"__rank_{out}", rank)
            pick = F.min_by if e["op"] == "first" else F.max_by
            cols.append(pick(c, F.when(c.isNotNull(), F.col(f"__rank_{out}"))).alias(f"__agg_{out}"))
        else:
            cols.append(AGGREGATES[e["op"]](c).alias(f"__agg_{out}"))
    sums = df.groupBy(*subset).agg(*cols)
    got = null_safe_join(firsts, sums, subset)
    return got.withColumns({o: F.col(f"__agg_{o}") for o in agg}).drop(*[f"__agg_{o}" for o in agg])
