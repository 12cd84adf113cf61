"""Points near points, and points in regions, over space-filling-curve cells.

Both searches turn locations into sorted Morton codes. A disc is covered by one range of codes in each of the few cells,
some discs wide, that it meets (between the codes of the corners of its box in the cell), and the ranges are joined to
the sorted codes of the cell. Regions are covered by quadtree cells, that is,
ranges of codes, which are matched to the sorted codes by one merge (``lastknown.scan``), and only cells on a region's
edge need the exact test, against the few edges that cross the cell's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import geo
from plumbline.operators import lastknown
from plumbline.session import cut

#: A region's cover goes down to cells of about this part of its longer side.
COVER_PARTS = 32
#: Salts for a cell that holds a large share of all locations.
CELL_SALTS = 16


def near_pairs(points: DataFrame, id_col: str, lat: str, lon: str, radius_m: float, hot_share: float = lastknown.HOT_SHARE, hot_rows: int = lastknown.HOT_ROWS) -> DataFrame:
    """Distinct pairs (``id_a`` < ``id_b``) of different ids that have locations at most ``radius_m`` apart.

    An id may have several locations and locations may repeat; rows with a null id or a null, NaN or impossible
    location pair with nothing. The cell level is the finest whose cells are four radii high or more, so most discs
    meet one to four cells; in each of them a disc is a range of Morton codes, which is joined to the cell's codes, and
    what lies in the range is measured. A pair is looked up once, from the location whose code (then id, then
    coordinates) is the smaller one, so ranges start no earlier than the own code. Cells with a large share of all
    locations are salted.
    """
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    p = points.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).distinct()
    r_deg = math.degrees(radius_m / geo.EARTH_RADIUS_M)
    level = max(1, min(geo.MAX_LEVEL, math.floor(math.log2(180.0 / max(4 * r_deg, 1e-9)))))
    shift, size = geo.MAX_LEVEL - level, 1 << geo.MAX_LEVEL
    top = (1 << level) - 1
    edge = r_deg * (1 + 1e-9) + 1e-12
    # columns of cells narrow towards the poles, so more of them are covered there
    wide = F.when(F.abs("lat") + edge >= 89.9, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(edge))) / F.cos(F.radians(F.col("lat")))))) * (1 + 1e-9) + 1e-12)
    p = p.withColumn("code", geo.point_code(F.col("lon"), F.col("lat"))).withColumn("cell", F.shiftright("code", 2 * shift))
    hot = lastknown.hot_keys(p, "cell", hot_share, hot_rows)
    is_hot = F.col("cell").isin(hot) if hot else F.lit(False)
    column = lambda v: F.floor((v + 180.0) / 360.0 * size)  # noqa: E731  (not cut off at the ends of the map, where it goes on)
    a = p.withColumns({"y0": geo.cell_axis(F.col("lat") - edge, -90.0, 180.0), "y1": geo.cell_axis(F.col("lat") + edge, -90.0, 180.0), "x0": column(F.col("lon") - wide), "x1": column(F.col("lon") + wide)})
    # around a pole, all columns
    round_ = F.col("x1") - F.col("x0") >= size
    a = a.withColumns({"x0": F.when(round_, 0).otherwise(F.col("x0")), "x1": F.when(round_, size - 1).otherwise(F.col("x1"))})
    # rows and columns of cells are exploded one after the other, so the codes are computed in generated code
    a = a.withColumn("cy", F.explode(F.sequence(F.shiftright("y0", shift), F.shiftright("y1", shift)))).withColumn("cx", F.explode(F.sequence(F.shiftright("x0", shift), F.shiftright("x1", shift))))
    start = lambda c: F.shiftleft(c, shift)
    last = (1 << shift) - 1
    here = F.pmod(F.col("cx"), F.lit(top + 1))
    # the corners of the disc's box in the cell; east and west of the map's ends the columns are counted on
    moved = start(here) - start(F.col("cx"))
    low = geo.interleave(F.greatest("x0", start(F.col("cx"))) + moved, F.greatest("y0", start(F.col("cy"))))
    high = geo.interleave(F.least("x1", start(F.col("cx")) + last) + moved, F.least("y1", start(F.col("cy")) + last))
    a = a.select(F.col("code").alias("own"), geo.interleave(here, F.col("cy")).alias("cell"), F.greatest(low, F.col("code")).alias("lo"), high.alias("hi"), F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).where("lo <= hi")
    b = p.select("cell", "code", F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    on = ["cell"]
    if hot:
        a = a.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id1", "lat1", "lon1"), F.lit(CELL_SALTS))).otherwise(0))
        b = b.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = ["cell", "salt"]
    once = (F.col("own") < F.col("code")) | (F.struct("id1", "lat1", "lon1") < F.struct("id2", "lat2", "lon2"))
    near = geo.great_circle_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= radius_m
    found = a.join(b, on).where(F.col("code").between(F.col("lo"), F.col("hi")) & (F.col("id1") != F.col("id2")) & once & near)
    return found.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b")).distinct()


_EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def region_cells(regions: DataFrame, id_col: str, geometry: str, parts: int = COVER_PARTS) -> DataFrame:
    """The quadtree cover of each region: ``level, lo, hi`` (codes at MAX_LEVEL), ``region, whole, edges``.

    ``whole`` cells lie inside the region; for the others ``edges`` has those edges that an eastward ray from a point
    of the cell can cross. Regions with null ids or unreadable or non-polygonal geometry have no cells. One region is
    one unit of work; its cover has some ``parts`` cells along its outline, however large it is.
    """
    out = f"level int, lo long, hi long, region string, whole boolean, edges array<{_EDGE}>"

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = [x for rid, g in zip(pdf["id"], pdf["g"], strict=True) for x in _cover(rid, geo.wkb_rings(g), parts)]
            yield pd.DataFrame(rows, columns=["level", "lo", "hi", "region", "whole", "edges"])

    src = regions.where(F.col(id_col).isNotNull() & F.col(geometry).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(geometry).alias("g"))
    # a fixed number, as small outlines would otherwise be put together into one task
    return src.repartition(2 * regions.sparkSession.sparkContext.defaultParallelism, "id").mapInPandas(run, out)


def _cover(region: str, geom: list | None, parts: int) -> Iterator[tuple]:
    import numpy as np

    rings = [r for part in geom or [] for r in part if len(r) >= 3]
    if not rings:
        return
    segs = []
    for r in rings:
        a = np.asarray(r, float)
        if (a[0] != a[-1]).any():
            a = np.vstack([a, a[:1]])
        segs.append(np.hstack([a[:-1], a[1:]]))
    e = np.vstack(segs)
    if not np.isfinite(e).all():
        return
    x0, x1 = min(e[:, 0].min(), e[:, 2].min()), max(e[:, 0].max(), e[:, 2].max())
    y0, y1 = min(e[:, 1].min(), e[:, 3].min()), max(e[:, 1].max(), e[:, 3].max())
    size = max((x1 - x0) / 360.0, (y1 - y0) / 180.0, 1e-9)
    finest = int(min(geo.MAX_LEVEL, max(1, math.ceil(math.log2(parts / size)))))
    start = max(0, min(finest, math.floor(math.log2(1 / size))))
    n = 1 << start
    cell = lambda v, low, span: int(min(n - 1, max(0, math.floor((v - low) / span * n))))
    todo = [(start, ix, iy, e) for ix in range(cell(x0, -180, 360), cell(x1, -180, 360) + 1) for iy in range(cell(y0, -90, 180), cell(y1, -90, 180) + 1)]
    while todo:
        level, ix, iy, near = todo.pop()
        w, h = 360.0 / (1 << level), 180.0 / (1 << level)
        # a hair wider than the cell, so that rounding can't put a point beside its cell's edges
        cx0, cy0, cx1, cy1 = -180 + ix * w - w * 1e-6, -90 + iy * h - h * 1e-6, -180 + (ix + 1) * w + w * 1e-6, -90 + (iy + 1) * h + h * 1e-6
        lows, highs = np.minimum(near[:, 1], near[:, 3]), np.maximum(near[:, 1], near[:, 3])
        rows = near[(lows <= cy1) & (highs >= cy0) & (np.maximum(near[:, 0], near[:, 2]) >= cx0)]
        if not len(rows):
            continue
        crossing = rows[_meets(rows, cx0, cy0, cx1, cy1)]
        shift = 2 * (geo.MAX_LEVEL - level)
        code = geo.morton(ix, iy) << shift
        if not len(crossing):
            if _odd(rows, (cx0 + cx1) / 2, (cy0 + cy1) / 2):
                yield level, code, code + (1 << shift) - 1, region, True, []
        elif level >= finest:
            yield level, code, code + (1 << shift) - 1, region, False, [{"x1": a, "y1": b, "x2": c, "y2": d} for a, b, c, d in rows.tolist()]
        else:
            todo += [(level + 1, 2 * ix + i, 2 * iy + j, rows) for i in (0, 1) for j in (0, 1)]


def _meets(e, x0, y0, x1, y1):
    """Which edges may touch the box: their bounds overlap it and its corners are not all strictly on one side."""
    import numpy as np

    over = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    s = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return over & ~((s > 0).all(0) | (s < 0).all(0))


def _odd(e, x: float, y: float) -> bool:
    import numpy as np

    up = (e[:, 1] > y) != (e[:, 3] > y)
    f = e[up]
    return bool((np.asarray(x < (f[:, 2] - f[:, 0]) * (y - f[:, 1]) / (f[:, 3] - f[:, 1]) + f[:, 0])).sum() % 2)


def contains(lon: Column, lat: Column, edges: Column) -> Column:
    """Whether an eastward ray from the point crosses an odd number of the edges (holes and parts count by themselves)."""
    crossed = F.filter(edges, lambda s: ((s["y1"] > lat) != (s["y2"] > lat)) & (lon < (s["x2"] - s["x1"]) * F.try_divide(lat - s["y1"], s["y2"] - s["y1"]) + s["x1"]))
    return F.size(crossed) % 2 == 1


def regions_of(points: DataFrame, lat: str, lon: str, regions: DataFrame, region_id: str, geometry: str, parts: int = COVER_PARTS, hot_share: float = lastknown.HOT_SHARE, hot_rows: int = lastknown.HOT_ROWS) -> DataFrame:
    """Each point with each region that contains it, as a column ``region`` (string); points in no region don't come out.

    Regions may overlap, and have holes and several parts; a column ``region`` of the points is replaced. A point exactly on an outline belongs to the region on one
    side of it (half-open in both axes). The cover's cells of one level are disjoint, so the last cell that starts at
    or before a point's code is the only one of its level that can hold it: one merge over sorted codes matches every
    level at once, and each cell carries the regions that share it.
    """
    cells = region_cells(regions, region_id, geometry, parts)
    shared = cells.groupBy("level", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("region", "whole", "edges"))).alias("held"))
    shared = cut(shared)
    levels = sorted(r[0] for r in shared.select("level").distinct().collect())  # at most MAX_LEVEL + 1 values
    kept = [c for c in points.columns if c != "region"]
    points = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("__p"), F.col(f"`{lat}`").cast("double").alias("__lat"), F.col(f"`{lon}`").cast("double").alias("__lon"))
    whole = [F.col("__p").getField(c).alias(c) for c in kept]
    if not levels:
        return points.where(F.lit(False)).select(*whole, F.lit(None).cast("string").alias("region"))
    shift = 2 * (geo.MAX_LEVEL - levels[0])  # every cell lies in one cell of the coarsest level: the key of the merge
    hist = shared.select(F.shiftright("lo", shift).alias("__k"), F.col("lo").alias("__c"), F.col("level").alias("kind"), F.struct("lo", "hi", "held").alias("entry"))
    ev = points.withColumn("__c", geo.point_code(F.col("__lon"), F.col("__lat"))).withColumn("__k", F.shiftright("__c", shift))
    found = lastknown.scan(ev, hist, "__k", "__c", levels, hot_share, hot_rows)
    held = F.flatten(F.array(*[F.when(F.col(f"known_{k}.hi") >= F.col("__c"), F.col(f"known_{k}.held")).otherwise(F.array().cast(dict(shared.dtypes)["held"])) for k in levels]))
    x, y = F.col("__lon"), F.col("__lat")
    inside = F.array_distinct(F.transform(F.filter(held, lambda c: c["whole"] | contains(x, y, c["edges"])), lambda c: c["region"]))
    return found.withColumn("__region", F.explode(inside)).select(*whole, F.col("__region").alias("region"))


def located(records: DataFrame, lat: str, lon: str, geometry: str, box: tuple[float, float, float, float]) -> DataFrame:
    """``records`` with ``loc_lat, loc_lon``: the stored coordinates where they lie in ``box`` (x0, y0, x1, y1), else the
    centre of the geometry's bounding box, else null. Geometry is decoded only for rows that need it."""
    records = records.drop("loc_lat", "loc_lon")
    x0, y0, x1, y1 = box
    good = F.coalesce(F.col(lat).between(y0, y1) & F.col(lon).between(x0, x1), F.lit(False))
    base = records.withColumn("__good", good)
    stored = base.where("__good").drop("__good", geometry).withColumns({"loc_lat": F.col(lat).cast("double"), "loc_lon": F.col(lon).cast("double")})
    rest = geo.with_bounds(base.where("not __good").drop("__good"), geometry, "__box")
    centred = rest.withColumns({"loc_lat": (F.col("__box_y0") + F.col("__box_y1")) / 2, "loc_lon": (F.col("__box_x0") + F.col("__box_x1")) / 2}).drop(geometry, "__box_x0", "__box_y0", "__box_x1", "__box_y1")
    return stored.unionByName(centred)


def extent(regions: DataFrame, geometry: str) -> tuple[float, float, float, float] | None:
    """The bounding box of all regions; one row comes to the driver."""
    b = geo.with_bounds(regions.select(geometry), geometry, "b").agg(F.min("b_x0"), F.min("b_y0"), F.max("b_x1"), F.max("b_y1")).first()
    return None if b is None or b[0] is None else tuple(b)


def found_near_and_inside(parcels: DataFrame, regions: DataFrame, radius_m: float = 12.0) -> DataFrame:
    """p2: (``key_a``, ``key_b``): different parcels at most ``radius_m`` apart, and each parcel with its region's id."""
    none = parcels.sparkSession.createDataFrame([], T.StructType([T.StructField("key_a", T.StringType()), T.StructField("key_b", T.StringType())]))
    box = extent(regions, "geometry")
    if box is None:
        box = (math.inf, math.inf, -math.inf, -math.inf)
    at = located(parcels.where(F.col("key").isNotNull()).select("key", "latitude", "longitude", "geometry"), "latitude", "longitude", "geometry", box)
    # read by both searches and by their counts of crowded cells: geometry is decoded once
    at = cut(at.where(F.col("loc_lat").isNotNull() & F.col("loc_lon").isNotNull()).select("key", "loc_lat", "loc_lon").distinct())
    near = near_pairs(at, "key", "loc_lat", "loc_lon", radius_m).select(F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    inside = regions_of(at, "loc_lat", "loc_lon", regions, "std_geoid", "geometry").select(F.col("key").alias("key_a"), F.col("region").alias("key_b")).distinct()
    return none.unionByName(near).unionByName(inside)
