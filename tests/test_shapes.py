import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import polygons
from plumbline.operators import ratios, shapes
from tests.test_spatial import SQUARE, inside, wkb


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_overlap_area():
    assert polygons.overlap_area([[box(0, 0, 2, 2)]], [[box(1, 1, 2, 2)]]) == pytest.approx(1)
    assert polygons.overlap_area([[box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)]], [[box(0, 0, 2, 2)]]) == pytest.approx(3)
    assert polygons.overlap_area([[box(0, 0, 1, 1)]], [[box(3, 0, 1, 1)]]) == 0
    diamond = [(0, -1), (1, 0), (0, 1), (-1, 0), (0, -1)]
    assert polygons.overlap_area([[diamond]], [[box(0, -2, 4, 4)]]) == pytest.approx(1)
    rnd = random.Random(4)
    star = lambda: [(math.cos(i * math.pi / 5) * rnd.uniform(0.3, 1), math.sin(i * math.pi / 5) * rnd.uniform(0.3, 1)) for i in range(10)]
    a, b = [[star()]], [[star()]]
    n = 40_000
    hits = sum(inside(a, x, y) and inside(b, x, y) for x, y in ((rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(n)))
    assert polygons.overlap_area(a, b) == pytest.approx(4 * hits / n, abs=0.05)


def test_rectangle_and_simplification():
    turned = [(x * 0.8 - y * 0.6, x * 0.6 + y * 0.8) for x, y in box(0, 0, 10, 2)]
    assert polygons.rotated_rectangle(turned) == pytest.approx((10, 2))
    wavy = [(0, 0), (1, 0.01), (2, 0), (2, 2), (1, 1.99), (0, 2), (0, 0)]
    assert len(polygons.simplified(wavy, 0.1)) == 4 and len(polygons.simplified(wavy, 0.001)) == 6


def test_shape_table_and_covered_area(spark):
    scale = lambda ring: [(x * 1e-3, y * 1e-3) for x, y in ring]
    df = spark.createDataFrame([("a", bytearray(wkb([scale(SQUARE)]))), ("b", bytearray(wkb([scale(box(0.5, 0, 6, 1))]))), ("c", None), ("d", bytearray(b"x"))], "k string, g binary")
    got = {r["k"]: r for r in shapes.shape_metrics(df, "k", "g").collect()}
    assert got["a"]["aspect_ratio"] == pytest.approx(1, abs=1e-3) and got["a"]["rectangularity"] == pytest.approx(1) and not got["a"]["is_irregular"]
    assert got["b"]["is_elongated"] and got["c"]["area_m2"] is None and got["d"]["vertices"] is None
    cover = {r["k"]: r["covered_m2"] for r in shapes.covered_area(df, df.where("k = 'b'").withColumnRenamed("k", "bid"), "k", "bid", "g").collect()}
    assert cover["a"] == pytest.approx(got["a"]["area_m2"] / 2, rel=1e-3) and cover["b"] == pytest.approx(got["b"]["area_m2"], rel=1e-3) and cover["c"] == 0
    tall = df.withColumn("height", F.when(F.col("k") == "b", 7.0).otherwise(3.0)).withColumnRenamed("k", "bid")
    assert {r["k"]: r["height"] for r in shapes.largest_of(df, tall, "k", "bid", "g", ["height"]).collect()} == {"a": 7.0, "b": 7.0, "c": None, "d": None}
    h = spark.createDataFrame([(float(x), float(y)) for x in (-90, 90) for y in (-45, 45)] + [(None, 1.0)], "x double, y double").coalesce(1)
    assert [r[0] for r in h.select(shapes.hilbert_code(F.col("x"), F.col("y"), 1)).collect()] == [0, 1, 3, 2, None]


def test_two_humps(spark):
    rnd = random.Random(5)
    data = [("one", math.exp(rnd.gauss(10, 0.3))) for _ in range(400)] + [("two", math.exp(rnd.gauss(m, 0.2))) for m in (9, 12) for _ in range(200)] + [("few", 1.0), (None, 5.0), ("one", -1.0)]
    got = {r["c"]: r["bimodal"] for r in ratios.two_humps(spark.createDataFrame(data, "c string, v double"), "c", "v").collect()}
    assert got == {"one": False, "two": True, "few": False}
