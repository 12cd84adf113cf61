import random

from plumbline.operators import frontage
from tests.conftest import rows


def test_first_hits_against_brute_force(spark):
    rnd = random.Random(6)
    p = lambda: (rnd.uniform(-60, 60), rnd.uniform(-60, 60))
    edges = [(f"k{i % 15}", *p(), *p()) for i in range(40)] + [("none", None, 1.0, 2.0, 3.0)]
    roads = [(1, 0.0, 0.0, 30.0, 10.0), (2, -20.0, 5.0, -20.0, -30.0), (3, 1.0, 1.0, 1.0, 1.0), (4, None, 0.0, 1.0, 1.0)]
    r = frontage.rays(spark.createDataFrame(roads, "road int, x1 double, y1 double, x2 double, y2 double"), "road", 1.0, 25.0)
    got = {x["ray"]: (x["key"], round(x["depth"], 6)) for x in frontage.first_hits(r, spark.createDataFrame(edges, "key string, ax double, ay double, bx double, by double"), "key", 25.0).collect()}
    want = {}
    for ray in r.collect():
        best = None
        for k, ax, ay, bx, by in edges[:-1]:
            rx, ry, sx, sy = ray["x1"] - ray["x0"], ray["y1"] - ray["y0"], bx - ax, by - ay
            c = rx * sy - ry * sx
            if c:
                t, u = ((ax - ray["x0"]) * sy - (ay - ray["y0"]) * sx) / c, ((ax - ray["x0"]) * ry - (ay - ray["y0"]) * rx) / c
                if 0 <= t <= 1 and 0 <= u <= 1 and (best is None or (t, k) < best):
                    best = (t, k)
        if best:
            want[ray["ray"]] = (best[1], round(best[0] * 25, 6))
    assert got == want and len(got) > 20 and {x["road"] for x in r.collect()} == {1, 2}


def test_one_lot_on_two_roads(spark):
    lot = [("a", 5.0, 5.0, 15.0, 5.0), ("a", 15.0, 5.0, 15.0, 25.0), ("a", 15.0, 25.0, 5.0, 25.0), ("a", 5.0, 25.0, 5.0, 5.0)]
    roads = [("south", -50.0, 0.0, 50.0, 0.0), ("east", 20.0, -50.0, 20.0, 50.0)]
    got = frontage.frontages(spark.createDataFrame(roads, "road string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(lot, "key string, ax double, ay double, bx double, by double"), "road", "key")
    assert rows(got) == [("a", "east", 20.0, 5.0, "E", 1), ("a", "south", 10.0, 5.0, "S", 2)]
