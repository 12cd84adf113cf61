"""Planar and geodesic expressions: polar coordinates, offsets, rectangles, normalisation, lot depth units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import EARTH_RADIUS_M

FEET_PER_METRE = 3.28084


def polar(x: Column, y: Column, cx: float, cy: float) -> tuple[Column, Column]:
    """Radius and angle in degrees about a centre."""
    return F.hypot(x - F.lit(cx), y - F.lit(cy)), F.degrees(F.atan2(y - F.lit(cy), x - F.lit(cx)))


def offset(lat: Column, lon: Column, north_m: float, east_m: float) -> tuple[Column, Column]:
    """A point moved north and east on the sphere (small distances)."""
    return lat + F.lit(north_m / EARTH_RADIUS_M * 57.29577951308232), lon + F.degrees(F.lit(east_m / EARTH_RADIUS_M) / F.cos(F.radians(lat)))


def rectangle(lat: Column, lon: Column, width_m: float, height_m: float) -> Column:
    """The closed ring of a rectangle about a point, as an array of (x, y)."""
    (n, e), (s, w) = offset(lat, lon, height_m / 2, width_m / 2), offset(lat, lon, -height_m / 2, -width_m / 2)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(w, s), p(e, s), p(e, n), p(w, n), p(w, s))


def ring_area(ring: Column) -> Column:
    """The shoelace area of an array of (x, y)."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2


def equal_area_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area coordinates in metres about a centre."""
    p, q, p0 = F.radians(lat), F.radians(lon - F.lit(lon0)), F.radians(F.lit(lat0))
    k = F.sqrt(2 / (1 + F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(q)))
    return F.lit(EARTH_RADIUS_M) * k * F.cos(p) * F.sin(q), F.lit(EARTH_RADIUS_M) * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(q))


def min_max(df: DataFrame, fields: list[str]) -> DataFrame:
    """``<field>_norm`` in [0, 1] over the whole table; 0 where the field does not vary. One row of bounds is sent around."""
    b = df.agg(*[x for f in fields for x in (F.min(f).alias(f"__lo_{f}"), F.max(f).alias(f"__hi_{f}"))])
    got = df.crossJoin(F.broadcast(b))
    out = got.withColumns({f"{f}_norm": F.when(F.col(f).isNotNull(), F.coalesce(F.try_divide(F.col(f) - F.col(f"__lo_{f}"), F.col(f"__hi_{f}") - F.col(f"__lo_{f}")), F.lit(0.0))) for f in fields})
    return out.drop(*b.columns)


def depth_percent(depth_ft: Column) -> Column:
    """The value share of a lot's depth against a 100 ft lot: 1.336 (1 - e^(-0.0326 d^0.813)) to three places, 1 at 100 ft."""
    raw = F.floor(F.lit(1.336) * (1 - F.exp(F.lit(-0.0326) * F.pow(depth_ft, F.lit(0.813)))) * 1000 + 0.5) / 1000
    return F.when(depth_ft == 100, 1.0).when(depth_ft <= 0, 0.0).otherwise(raw)


def unit_feet(frontage_ft: Column, depth_ft: Column) -> Column:
    return depth_percent(depth_ft) * frontage_ft


def value_per_unit(lot_value: Column, frontage_ft: Column, depth_ft: Column) -> Column:
    return F.try_divide(lot_value, unit_feet(frontage_ft, depth_ft))


def decay(kind: str, distance: Column, alpha: float = 1.0) -> Column:
    """Value surfaces by distance from a centre in [0, 1]: linear, inverse_square or exponential."""
    if kind == "linear":
        return F.greatest(F.lit(0.0), 1 - distance)
    if kind == "inverse_square":
        return 1 / F.pow(1 + distance, 2)
    if kind == "exponential":
        return F.exp(-F.lit(alpha) * distance)
    raise ValueError(kind)


def overlaps(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether two bounding boxes meet."""
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def circle(lat: Column, lon: Column, radius_m: float, points: int = 32) -> Column:
    """The closed ring of a circle about a point, as an array of (x, y)."""
    import math

    p = []
    for i in [*range(points), 0]:
        a = 2 * math.pi * i / points
        y, x = offset(lat, lon, radius_m * math.sin(a), radius_m * math.cos(a))
        p.append(F.struct(x.alias("x"), y.alias("y")))
    return F.array(*p)


def unit_metres(frontage_m: Column, depth_m: Column) -> Column:
    """``unit_feet`` for metres, in metres of frontage."""
    return depth_percent(F.round(depth_m * FEET_PER_METRE, 6)) * frontage_m
