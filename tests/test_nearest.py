"""Nearest features: exact whatever the crowding, and without comparing all that lie within the limit."""

import math
import random
import time

from pyspark.sql import functions as F

from plumbline.operators import neighbors


def test_against_all_pairs(spark):
    rnd = random.Random(5)
    grid = lambda n, s: [(i, round(rnd.random() * s, 3), round(rnd.random() * s, 3)) for i in range(n)]
    tight = [(1000 + i, 0.5 + i % 7 * 1e-7, 0.5 + i % 11 * 1e-7) for i in range(200)]
    fs = grid(300, 1.0) + tight + [(2000, 3.0, 3.0), (2001, None, 1.0), (2002, float("nan"), 1.0)]
    ps = grid(300, 1.2) + [(5000 + i, 0.5 + i * 1e-7, 0.5) for i in range(20)] + [(6000, 3.0, 3.1), (6001, 3.0, 3.15), (6002, None, 3.0), (6003, float("nan"), 3.0), (6004, -1.0, 0.0), (6005, 0.5, 0.5), (6006, 0.5, 0.5)]
    p, f = spark.createDataFrame(ps, "id int, x double, y double"), spark.createDataFrame(fs, "fid int, x double, y double")
    ok = lambda r: all(c is not None and c == c for c in r[1:])
    for limit in (0.1, 5.0):
        want = {}
        for i, x, y in ps:
            d = min(((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in filter(ok, fs)), default=None) if ok((i, x, y)) else None
            want[i] = (*d, True, limit - d[0]) if d and d[0] <= limit else (None, None, False, 0.0)
        got = neighbors.nearest_feature(p, f, "id", "fid", "x", "y", limit)
        assert got.columns == ["id", "distance", "fid", "within", "proximity"]
        got = got.collect()
        assert {r["id"]: tuple(r)[1:] for r in got} == want and len(got) == len(ps)
    assert neighbors.nearest_feature(p, f.where("fid < 0"), "id", "fid", "x", "y", 0.1).where("within").isEmpty()


def test_crowded_cell(spark):
    """A hundred thousand points and features within one limit: not ten billion pairs."""
    k = F.col("id")
    df = spark.range(100_000).select("id", ((k * 37 % 1000) / 1e5).alias("x"), ((k * 91 % 997) / 1e5).alias("y"))
    f = df.select(k.alias("fid"), F.col("x"), (F.col("y") + 0.000002).alias("y"))
    began = time.time()
    got = neighbors.nearest_feature(df, f, "id", "fid", "x", "y", 0.1).agg(F.count_if("within").alias("n"), F.max("distance").alias("d")).first()
    assert got["n"] == 100_000 and got["d"] < 3e-6 and time.time() - began < 90
