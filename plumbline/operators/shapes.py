"""Parcel shapes and overlaps of two polygon layers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import geo, polygons
from plumbline.operators.spatial import region_cells
from plumbline.session import cut


def shape_metrics(df: DataFrame, key: str, geometry: str, tolerance_m: float = 10.0, complex_from: int = 12, rectangular_to: float = 0.75, elongated_from: float = 5.0) -> DataFrame:
    """``key, area_m2, rectangularity, aspect_ratio, vertices, is_complex, is_elongated, is_irregular`` of each outline.

    Rectangularity is 1 - |A(smallest rectangle) - A| / A; vertices are counted after simplification. Rows whose
    geometry can't be read, or isn't a polygon, come out with nulls.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, g in zip(pdf["k"], pdf["g"], strict=True):
                parts = geo.wkb_rings(g)
                ring = max((p[0] for p in parts or []), key=len, default=[])
                if len(ring) < 3:
                    rows.append((k, None, None, None, None))
                    continue
                x0, y0, x1, y1 = geo.bounds_of(parts)
                m = polygons.to_metres(ring, (x0 + x1) / 2, (y0 + y1) / 2)
                a, (long, short) = polygons.area(m), polygons.rotated_rectangle(m)
                rows.append((k, a, 1 - abs(long * short - a) / a if a else None, long / short if short else None, len(polygons.simplified(m, tolerance_m))))
            yield pd.DataFrame(rows, columns=["k", "area_m2", "rectangularity", "aspect_ratio", "vertices"]).astype({"vertices": "Int64"})

    got = df.select(F.col(key).alias("k"), F.col(geometry).alias("g")).mapInPandas(run, f"k {kind}, area_m2 double, rectangularity double, aspect_ratio double, vertices long")
    got = got.withColumns({"is_complex": F.col("vertices") >= complex_from, "is_elongated": F.col("aspect_ratio") >= elongated_from})
    return got.withColumn("is_irregular", F.col("is_complex") | F.col("is_elongated") | (F.col("rectangularity") < rectangular_to)).withColumnRenamed("k", key)


@F.pandas_udf(T.DoubleType())
def _shared_m2(a, b):
    import pandas as pd

    def one(x, y):
        p, q = geo.wkb_rings(x), geo.wkb_rings(y)
        if not p or not q:
            return 0.0
        x0, y0, x1, y1 = geo.bounds_of(p)
        flat = lambda parts: [[polygons.to_metres(r, (x0 + x1) / 2, (y0 + y1) / 2) for r in rings] for rings in parts]
        return polygons.overlap_area(flat(p), flat(q))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, geometry: str, parts: int = 4) -> DataFrame:
    """``left_id, right_id, shared_m2`` of polygons that share area.

    Both layers are covered by quadtree cells; two cells meet if one is the other or lies in it. Each cell is looked up
    under its ancestors on the levels that the other layer uses, so candidates meet by two equality joins.
    """
    a = cut(region_cells(left, left_id, geometry, parts).select(F.col("level").alias("at"), "lo", F.col("region").alias("a")))
    b = cut(region_cells(right, right_id, geometry, parts).select(F.col("level").alias("at"), "lo", F.col("region").alias("b")))
    code = lambda at: F.expr(f"shiftright(lo, cast(2 * ({geo.MAX_LEVEL} - {at}) as int))")
    own = lambda df, n: df.select("at", code("at").alias("c"), n).distinct()

    def above(df: DataFrame, n: str, other: DataFrame, same: bool) -> DataFrame:
        levels = sorted(r[0] for r in other.select("at").distinct().collect())  # at most 27
        up = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: (x <= F.col("at")) if same else (x < F.col("at")))).alias("up")
        return df.select("lo", n, up).select(F.col("up").alias("at"), code("up").alias("c"), n).distinct()

    pairs = above(a, "a", b, True).join(own(b, "b"), ["at", "c"]).select("a", "b").unionByName(own(a, "a").join(above(b, "b", a, False), ["at", "c"]).select("a", "b")).distinct()
    geoms = lambda df, i, n: df.select(F.col(i).cast("string").alias(n), F.col(geometry).alias(f"g_{n}"))
    full = pairs.join(geoms(left, left_id, "a"), "a").join(geoms(right, right_id, "b"), "b")
    return full.select(F.col("a").alias(left_id), F.col("b").alias(right_id), _shared_m2("g_a", "g_b").alias("shared_m2")).where("shared_m2 > 0")


def covered_area(left: DataFrame, right: DataFrame, left_id: str, right_id: str, geometry: str) -> DataFrame:
    """``left_id, covered_m2``: the area of all ``right`` polygons within each ``left`` one (0 where there is none)."""
    s = overlaps(left, right, left_id, right_id, geometry).groupBy(left_id).agg(F.sum("shared_m2").alias("covered_m2"))
    return left.select(F.col(left_id).cast("string").alias(left_id)).distinct().join(s, left_id, "left").withColumn("covered_m2", F.coalesce("covered_m2", F.lit(0.0)))


def hilbert_code(lon: Column, lat: Column, bits: int = 16) -> Column:
    """The place of a point on a Hilbert curve with ``bits`` per axis; null for null and NaN."""

    @F.pandas_udf(T.LongType())
    def code(x, y):
        import numpy as np
        import pandas as pd

        n = 1 << bits
        good = (x.notna() & y.notna()).to_numpy()
        a = np.clip((x.fillna(0).to_numpy() + 180) / 360 * n, 0, n - 1).astype(np.int64)
        b = np.clip((y.fillna(0).to_numpy() + 90) / 180 * n, 0, n - 1).astype(np.int64)
        d = np.zeros(len(a), np.int64)
        s = n // 2
        while s:
            rx, ry = ((a & s) > 0).astype(np.int64), ((b & s) > 0).astype(np.int64)
            d += s * s * ((3 * rx) ^ ry)
            flip = ry == 0
            turn = flip & (rx == 1)
            a, b = np.where(turn, n - 1 - a, a), np.where(turn, n - 1 - b, b)
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            s //= 2
        return pd.Series(d, dtype="Int64").mask(~good)

    return code(lon.cast("double"), lat.cast("double"))


def largest_of(left: DataFrame, right: DataFrame, left_id: str, right_id: str, geometry: str, fields: list[str]) -> DataFrame:
    """``left_id`` and the largest value of each field among the ``right`` polygons that share area with it (null if none)."""
    o = overlaps(left, right, left_id, right_id, geometry).select(left_id, right_id)
    s = o.join(right.select(F.col(right_id).cast("string").alias(right_id), *fields), right_id).groupBy(left_id).agg(*[F.max(f).alias(f) for f in fields])
    return left.select(F.col(left_id).cast("string").alias(left_id)).distinct().join(s, left_id, "left")
