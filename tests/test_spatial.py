import math
import random
import struct

from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import spatial
from tests.conftest import SMALL, rows


def distance(a, b):
    (y1, x1), (y2, x2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


def inside(parts, x, y):
    odd = False
    for part in parts:
        for ring in part:
            for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
                    odd = not odd
    return odd


def wkb(rings, order="<", flags=3, srid=None, z=False):
    out = (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", flags) + (struct.pack(order + "I", srid) if srid else b"") + struct.pack(order + "I", len(rings))
    for r in rings:
        out += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "d" * (3 if z else 2), *p, *([9.0] if z else [])) for p in r)
    return out


SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_wkb_encodings():
    plain = geo.wkb_rings(wkb([SQUARE]))
    assert plain == [[SQUARE]]
    for other in (wkb([SQUARE], ">"), wkb([SQUARE], flags=1003, z=True), wkb([SQUARE], flags=0x80000003, z=True), wkb([SQUARE], flags=0x20000003, srid=4326), wkb([SQUARE]).hex(), wkb([SQUARE]).hex().encode()):
        assert geo.wkb_rings(other) == plain
    for broken in (None, b"", b"\x01", b"\x07abc", wkb([SQUARE])[:40], "zz"):
        assert geo.wkb_rings(broken) is None


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    pts = [(f"k{i % 150}", 39 + rnd.random() * 0.002, -96 + rnd.random() * 0.002) for i in range(300)]
    pts += [("k1", 39.0, -96.0), ("k1", 39.0, -96.0), ("k2", 39.0, -96.0), ("bad", None, -96.0), ("bad", float("nan"), -96.0), (None, 39.0, -96.0), ("far", 95.0, 500.0)]
    pts += [("w", 10.0, 179.99999), ("e", 10.0, -179.99999), ("p", 89.99995, 0.0), ("q", 89.99995, 180.0)]
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(pts) for b in pts[:i] if a[0] and b[0] and a[0] != b[0] and all(isinstance(v, float) and abs(v) <= 180 for v in (*a[1:], *b[1:])) and max(abs(a[1]), abs(b[1])) <= 90 and distance(a[1:], b[1:]) <= 12}
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    assert ("e", "w") in want and ("p", "q") in want
    for share, least in ((1 / 64, 10**6), (0.001, 1)):
        assert {tuple(r) for r in spatial.near_pairs(df, "id", "lat", "lon", 12.0, share, least).collect()} == want
    assert spatial.near_pairs(df.limit(0), "id", "lat", "lon", 12.0).count() == 0


def test_regions_against_brute_force(spark):
    rnd = random.Random(6)
    hole = [(0.3, 0.3), (0.3, 0.6), (0.6, 0.6), (0.6, 0.3), (0.3, 0.3)]
    star = [(2 + (1 if i % 2 else 0.4) * math.cos(i * math.pi / 7), (1 if i % 2 else 0.4) * math.sin(i * math.pi / 7)) for i in range(14)]
    shapes = {"A": wkb([SQUARE, hole]), "B": wkb([star], ">"), "C": wkb([[(0.5, 0.5), (0.5, 3), (3, 0.5)]]), "none": None, "bad": b"\x01\x02"}
    regions = spark.createDataFrame([(k, bytearray(v) if v else None, 1) for k, v in shapes.items()], "rid string, geom binary, lat int")
    pts = [(i, rnd.uniform(-1, 4), rnd.uniform(-1, 4)) for i in range(3000)] + [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, float("inf"), 1.0)]
    points = spark.createDataFrame(pts, "i int, lon double, lat double")
    want = {(i, r) for i, x, y in pts if x is not None and math.isfinite(x) for r, v in shapes.items() if v and geo.wkb_rings(v) and inside(geo.wkb_rings(v), x, y)}
    for share, least in ((1 / 64, 10**6), (0.01, 1)):
        got = spatial.regions_of(points, "lat", "lon", regions, "rid", "geom", hot_share=share, hot_rows=least)
        assert got.columns == ["i", "lon", "lat", "region"]
        assert {(r["i"], r["region"]) for r in got.collect()} == want
    assert spatial.regions_of(points, "lat", "lon", regions.limit(0), "rid", "geom").count() == 0


def test_found_on_the_small_tables(spark):
    u, b = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("universe", "block_groups"))
    polys = {r["std_geoid"]: geo.wkb_rings(r["geometry"]) for r in b.collect()}
    boxes = [geo.bounds_of(p) for p in polys.values()]
    x0, y0, x1, y1 = min(q[0] for q in boxes), min(q[1] for q in boxes), max(q[2] for q in boxes), max(q[3] for q in boxes)
    at = set()
    for r in u.collect():
        lat, lon = r["latitude"], r["longitude"]
        if lat is None or lon is None or not (y0 <= lat <= y1 and x0 <= lon <= x1):
            q = geo.bounds_of(geo.wkb_rings(r["geometry"]))
            if q is None:
                continue
            lon, lat = (q[0] + q[2]) / 2, (q[1] + q[3]) / 2
        at.add((r["key"], lat, lon))
    at = sorted(at)
    want = {(k, g) for k, lat, lon in at for g, p in polys.items() if inside(p, lon, lat)}
    want |= {tuple(sorted((a[0], c[0]))) for i, a in enumerate(at) for c in at[:i] if a[0] != c[0] and distance(a[1:], c[1:]) <= 12}
    assert {tuple(r) for r in spatial.found_near_and_inside(u, b).collect()} == want
    assert spatial.found_near_and_inside(u.limit(0), b).count() == 0
    assert rows(spatial.found_near_and_inside(u, b.limit(0)).select("key_b").where(F.length("key_b") == 12)) == []
