"""Street frontage: rays from points along roads, the first parcel that each ray meets, totals per parcel and road.

Coordinates are planar (metres). Rays and parcel edges meet by equality on grid cells as wide as a ray is long, and the
crossing is an expression, so everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions of eighths of the circle, from east counter-clockwise.
FACINGS = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]


def rays(roads: DataFrame, road_id: str, spacing: float, reach: float) -> DataFrame:
    """``road, ray, step, x0, y0, x1, y1``: from the middle of each piece of at most ``spacing`` of a segment (``x1, y1, x2, y2``)
    to both sides. Segments without length or with nulls have none."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    r = roads.select(F.col(road_id).alias("road"), "x1", "y1", dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("len")).where("len > 0")
    n = F.ceil(F.col("len") / spacing)
    r = r.withColumns({"n": n, "i": F.explode(F.sequence(F.lit(0).cast("long"), n - 1))}).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    t = (F.col("i") + 0.5) / F.col("n")
    x0, y0 = F.col("x1") + t * F.col("dx"), F.col("y1") + t * F.col("dy")
    x1, y1 = x0 - F.col("side") * reach * F.col("dy") / F.col("len"), y0 + F.col("side") * reach * F.col("dx") / F.col("len")
    return r.select("road", F.xxhash64("road", "x1", "y1", "dx", "dy", "i", "side").alias("ray"), (F.col("len") / F.col("n")).alias("step"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _cells(df: DataFrame, xa: str, ya: str, xb: str, yb: str, size: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return df.withColumn("cx", F.explode(span(xa, xb))).withColumn("cy", F.explode(span(ya, yb)))


def first_hits(road_rays: DataFrame, edges: DataFrame, key: str, reach: float) -> DataFrame:
    """``road, ray, step, key, depth, angle``: the first parcel edge (``key, ax, ay, bx, by``) that each ray crosses; ties go to
    the smaller key."""
    r = _cells(road_rays, "x0", "y0", "x1", "y1", reach)
    e = _cells(edges.select(F.col(key).alias("key"), "ax", "ay", "bx", "by").dropna(), "ax", "ay", "bx", "by", reach)
    rx, ry, sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = F.col("ax") - F.col("x0"), F.col("ay") - F.col("y0")
    cross: Column = rx * sy - ry * sx
    j = r.join(e, ["cx", "cy"]).withColumns({"t": F.try_divide(qx * sy - qy * sx, cross), "u": F.try_divide(qx * ry - qy * rx, cross)})
    hit = j.where(F.col("t").between(0, 1) & F.col("u").between(0, 1))
    best = hit.groupBy("road", "ray").agg(F.min(F.struct("t", "key", "step", F.degrees(F.atan2(-ry, -rx)).alias("angle"))).alias("b"))
    return best.select("road", "ray", F.col("b.step").alias("step"), F.col("b.key").alias("key"), (F.col("b.t") * reach).alias("depth"), F.col("b.angle").alias("angle"))


def frontages(roads: DataFrame, edges: DataFrame, road_id: str, key: str, spacing: float = 1.0, reach: float = 25.0, least: float = 2.0) -> DataFrame:
    """``key, road, frontage, set_back, facing, place``: the length of each parcel's front on each road (rays x spacing), its mean
    distance from the road's line, which way it faces, and its rank by length. Fronts under ``least`` are left out."""
    hits = first_hits(rays(roads, road_id, spacing, reach), edges, key, reach)
    a = F.radians("angle")
    s = hits.groupBy("key", "road").agg(F.sum("step").alias("frontage"), F.avg("depth").alias("set_back"), F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))).alias("angle")).where(F.col("frontage") >= least)
    eighth = F.pmod(F.round(F.col("angle") / 45), F.lit(8)).cast("int")
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("frontage"), "road"))  # a parcel has few roads
    return s.select(F.col("key").alias(key), "road", "frontage", "set_back", F.get(F.array(*[F.lit(f) for f in FACINGS]), eighth).alias("facing"), place.alias("place"))
