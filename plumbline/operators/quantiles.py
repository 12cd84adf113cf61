"""Exact quantiles (linear interpolation) of groups of any size.

A sketch of bounded size brackets each quantile; only the values between its brackets are counted and sorted. Counts
tell whether the brackets hold the rank, and they are widened, in the end to all values, if they do not. So the
sketch decides about the work only, never about the result, and no task holds a group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.skew import SMALL_ROWS, null_safe_join
from plumbline.session import cut

#: The sketch's error is a share of 1 / ACCURACY of a group; the brackets are WIDTH to either side. Groups of FEW rows or less have none.
ACCURACY = 2_000
WIDTH = 0.004
FEW = 100_000

#: ``medians``: buckets per doubling of a value, and into which a bracket is cut again; values of a bracket that are sorted;
#: brackets up to which a filter has one range each, before they are merged.
OCTAVE = 32
PARTS = 4_096
HELD = 500_000
RANGES = 64


def exact(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", width: float = WIDTH, few: int = FEW) -> DataFrame:
    """``by, n, <out>``: each group's quantiles as an array in the order of ``probs``; nulls left out, NaN is the largest.

    Groups without values have no row; with no ``by`` there is one row, of nulls if there are no values. ``df`` is read
    three times, so it should be at hand (``session.kept``).
    """
    v = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    join = lambda a, b: null_safe_join(a, b, by) if by else a.crossJoin(F.broadcast(b))
    while True:
        at = [min(1.0, max(0.0, p + s * width)) for p in probs for s in (-1, 1)]
        s = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.percentile_approx("__v", at, ACCURACY).alias("__m"))
        big = F.col("n") > few
        marks = cut(s.select(*by, "n", *[F.when(big & F.lit(at[j] > 0 if j % 2 == 0 else at[j] < 1), F.col("__m")[j]).otherwise(F.col("__a" if j % 2 == 0 else "__z")).alias(f"__e{j}") for j in range(len(at))]))
        few_groups = marks.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
        j = join(v, F.broadcast(marks) if few_groups else marks)
        lo, hi = [F.col(f"__e{2 * i}") for i in range(len(probs))], [F.col(f"__e{2 * i + 1}") for i in range(len(probs))]
        below = j.groupBy(*by).agg(F.first("n").alias("n"), *[F.count_if(F.col("__v") < x).alias(f"__b{i}") for i, x in enumerate(lo)])
        below = below.select(*by, "n", F.posexplode(F.array(*[f"__b{i}" for i in range(len(probs))])).alias("__i", "__below"))
        within = [F.when((F.col("__v") >= a) & (F.col("__v") <= z), F.lit(i)) for i, (a, z) in enumerate(zip(lo, hi, strict=True))]
        inside = j.where(F.coalesce(*within).isNotNull()).select(*by, "__v", F.explode(F.array_compact(F.array(*within))).alias("__i"))
        inside = inside.groupBy(*by, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = null_safe_join(inside.withColumn("__upto", upto), below, [*by, "__i"])
        position = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1)
        reached = F.col("__below") + F.col("__upto")
        got = placed.withColumn("__p", position).groupBy(*by, "__i").agg(
            F.first("n").alias("n"), F.first("__p").alias("__p"), F.min(F.when(reached > F.floor("__p"), F.col("__v"))).alias("__x"), F.min(F.when(reached > F.ceil("__p"), F.col("__v"))).alias("__y"), F.first("__below").alias("__below"), F.max(reached).alias("__to")
        )
        got = cut(got.withColumn("__ok", (F.col("__below") <= F.floor("__p")) & (F.col("__to") > F.ceil("__p"))))
        # as many quantiles as were asked for must be there, so a bracket without any value fails, too
        held = got.agg(F.count_if("__ok").alias("k")).first()["k"]
        if held == marks.where("n > 0").count() * len(probs) or width >= 1:
            break
        width = 1.0 if width > 0.1 else width * 8
    return _arranged(got, marks, by, len(probs), out)


def _arranged(got: DataFrame, marks: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    """One row per group: the interpolated values in the order asked for."""
    x, y, p = F.col("__x"), F.col("__y"), F.col("__p")
    q = F.when(x == y, x).otherwise((F.ceil(p) - p) * x + (p - F.floor(p)) * y)
    pick: list[Column] = [F.max(F.when(F.col("__i") == i, F.col("__q"))) for i in range(k)]
    rows = got.withColumn("__q", q).groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.array(*pick).alias(out))
    return rows


def median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``by, <out>``: each group's median."""
    return exact(df, by, value, [0.5]).select(*by, F.col("q")[0].alias(out))


def medians(df: DataFrame, groupings: list[list[str]], value: str, outs: list[str], octave: int = OCTAVE, parts: int = PARTS, held: int = HELD) -> list[DataFrame]:
    """For each grouping its columns and each group's median under the name in ``outs``; exact, and found for all in common passes.

    Null values and groups with a null key are left out; a grouping without columns has one row, of null if there are
    no values. The first pass counts values by cell (all columns together) and logarithmic bucket, with each bucket's least and
    greatest value, so the counts tell which bucket holds a group's middle ranks. Where the bucket has several values, the
    next pass cuts it into ``parts``, or sorts it if it has at most ``held`` values, until none is left. Later passes start with
    a filter of the ranges of values that are open (one range for all of many groups), which is pushed down, so ``df`` need not be
    kept.
    """
    cols = list(dict.fromkeys(c for by in groupings for c in by))
    v = df.select(*cols, F.col(value).cast("double").alias("__v")).where("__v is not null")
    own = lambda c: F.col("__g").isin([i for i, by in enumerate(groupings) if c in by])
    there = [F.when(F.lit(True) if not by else F.expr(" and ".join(f"`{c}` is not null" for c in by)), F.lit(i)) for i, by in enumerate(groupings)]
    by_group = lambda rows, *more: rows.groupBy("__g", *[F.when(own(c), F.col(f"`{c}`")).alias(c) for c in cols], *more)
    values = [F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__z")]
    keys = ["__g", *cols]

    cells = v.groupBy(*cols, _log_bucket(F.col("__v"), octave).alias("__k")).agg(*values)
    cells = cells.withColumn("__g", F.explode(F.array_compact(F.array(*there))))
    h = by_group(cells, "__k").agg(F.sum("__c").alias("__c"), F.min("__a").alias("__a"), F.max("__z").alias("__z"))
    h = h.withColumns({"__n": F.sum("__c").over(Window.partitionBy(*keys)), "__below": F.lit(0)})
    found = []
    while True:
        state = cut(_middle(h, keys))
        found.append(state.where("not __open"))
        todo = state.where("__open")
        left = todo.agg(F.count(F.lit(1)).alias("k"), F.min("__a").alias("a"), F.max("__z").alias("z")).first()
        if not left["k"]:
            break
        spans = [(left["a"], left["z"])] if left["k"] > RANGES else _merged(todo.select("__a", "__z").collect())
        rows = v.where(reduce(or_, [F.col("__v").between(a, z) for a, z in spans]))
        bucket = []
        for i, by in enumerate(groupings):
            of = todo.where(F.col("__g") == i).select(*[F.col(f"`{c}`").alias(f"__key_{c}") for c in by], *[F.col(c).alias(f"{c}{i}") for c in ("__a", "__z", "__in")])
            same = [F.col(f"`{c}`") == F.col(f"`__key_{c}`") for c in by] or F.lit(True)
            rows = rows.join(F.broadcast(of) if left["k"] <= SMALL_ROWS else of, same, "left").drop(*[f"__key_{c}" for c in by])
            a, z = F.col(f"__a{i}"), F.col(f"__z{i}")
            part = F.when(F.col(f"__in{i}") <= held, F.col("__v")).otherwise(F.floor((F.col("__v") - a) / (z - a) * parts).cast("double"))
            bucket.append(F.when(F.col("__v").between(a, z), F.struct(F.lit(i).alias("__g"), part.alias("__k"))))
        inside = rows.where(F.coalesce(*bucket).isNotNull()).select(*cols, "__v", F.explode(F.array_compact(F.array(*bucket))).alias("__b")).select(*cols, "__v", "__b.*")
        h = null_safe_join(by_group(inside, "__k").agg(*values), todo.select(*keys, "__n", "__below"), keys)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = cut(every.withColumn("__q", F.when(F.col("__x") == F.col("__y"), F.col("__x")).otherwise(0.5 * F.col("__x") + 0.5 * F.col("__y"))))
    rows = [every.where(F.col("__g") == i) for i in range(len(groupings))]
    return [r.select(*by, F.col("__q").alias(out)) if by else r.agg(F.max("__q").alias(out)) for r, by, out in zip(rows, groupings, outs, strict=True)]


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The same ranges, those that overlap as one."""
    out = []
    for a, z in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _log_bucket(v: Column, octave: int) -> Column:
    """A whole number that never falls as ``v`` rises: zero, the infinities and NaN have their own."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1100) * octave)
    return F.when(v == 0, F.lit(0.0)).when(F.isnan(v), F.lit(1e9)).otherwise(F.signum(v) * size)


def _middle(h: DataFrame, keys: list[str]) -> DataFrame:
    """From counted buckets, their order being ``__k``: the two middle values ``__x`` and ``__y`` of each group, or, if ``__open``,
    the range ``__a`` to ``__z`` of the one bucket that holds both, its size and the number of values before it."""
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")
    upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at, to = F.col("__upto") > low, F.col("__upto") > high
    s = h.withColumn("__upto", upto).groupBy(*keys).agg(
        F.max("__n").alias("__n"), F.greatest(F.max("__below"), F.max(F.when(~at, F.col("__upto")))).alias("__below"), F.min(F.when(at, F.col("__upto"))).alias("__end"),
        F.min(F.when(at, F.col("__a"))).alias("__a"), F.min(F.when(at, F.col("__z"))).alias("__z"), F.min(F.when(to, F.col("__a"))).alias("__y"),
    )
    s = s.withColumn("__open", (F.col("__end") > high) & (F.col("__a") != F.col("__z")))
    return s.select(*keys, "__n", "__below", (F.col("__end") - F.col("__below")).alias("__in"), "__a", "__z", F.col("__z").alias("__x"), "__y", "__open")
