import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import income, planar
from plumbline.operators import neighbors, predict, ratios, split


def test_linear_against_numpy(spark):
    rnd = random.Random(1)
    data = [(i % 3, rnd.random(), rnd.random(), rnd.random()) for i in range(300)]
    data = [(g, a, b, 3 + 2 * a - b + g * a + c / 10) for g, a, b, c in data] + [(0, None, 1.0, 1.0), (1, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "g int, a double, b double, y double")
    for g, r in {r["g"]: r for r in predict.linear(df, ["a", "b"], "y", ["g"]).collect()}.items():
        m = np.array([x[1:] for x in data if x[0] == g and None not in x])
        want, *_ = np.linalg.lstsq(np.c_[np.ones(len(m)), m[:, :2]], m[:, 2], rcond=None)
        assert np.allclose(r["coef"], want) and r["n"] == len(m) and 0.9 < r["r2"] <= 1 and abs(r["t"][1]) > 10
    assert predict.recursive_drop(df.withColumn("noise", F.pmod(F.xxhash64("a"), F.lit(97)).cast("double")), ["a", "b", "noise"], "y", least_t=4) == ["a", "b"]
    assert predict.vif(df.dropna(), ["a", "b"])["a"] == pytest.approx(1, abs=0.1)


def test_ensemble_rows(spark):
    df = spark.createDataFrame([("k1", 10.0, 20.0, 60.0), ("k2", -10.0, 0.0, 40.0), ("k3", None, 1.0, 2.0), ("k4", None, None, None)], "key string, m1 double, m2 double, m3 double")
    m = ["m1", "m2", "m3"]
    got = {r["key"]: tuple(r)[1:] for r in df.select("key", predict.row_median([F.col(c) for c in m]), predict.row_mean([F.col(c) for c in m]), *predict.median_weights(m)).collect()}
    assert got == {"k1": (20.0, 30.0, 0.0, 1.0, 0.0), "k2": (0.0, 10.0, 0.0, 1.0, 0.0), "k3": (1.5, 1.5, 0.0, 0.5, 0.5), "k4": (None, None, 0.0, 0.0, 0.0)}
    t = df.withColumn("truth", F.lit(20.0))
    assert predict.backward_ensemble(t.where("key = 'k1'"), "truth", m) in (["m2"], ["m2", "m1", "m3"], ["m2", "m1"])


def test_one_hot_and_local_area(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 40.0), (None, 3.0, 30.0), ("z", 0.0, 5.0)], "h string, area double, y double")
    assert [tuple(r) for r in predict.one_hot(df.select("h"), "h", ["b", "a", "c"]).orderBy("h").collect()] == [(None, 0, 0), ("a", 0, 0), ("b", 1, 0), ("z", 0, 0)]
    got = {r["h"]: r["prediction"] for r in predict.local_area(df, df, "y", "area", ["h"]).collect()}
    assert got == {"a": 10.0, "b": 40.0, None: 30.0, "z": 0.0}


def test_ratio_study_and_trim(spark):
    data = [("g", 90.0, 100.0), ("g", 100.0, 100.0), ("g", 130.0, 100.0), ("h", 50.0, 50.0), ("g", None, 10.0), ("g", 5.0, 0.0)]
    df = spark.createDataFrame(data, "g string, p double, t double")
    got = {r["g"]: r for r in ratios.ratio_study(df, ["g"], "p", "t").collect()}
    assert got["g"]["n"] == 3 and got["g"]["median_ratio"] == 1.0 and got["g"]["cod"] == pytest.approx(100 * (0.1 + 0.3) / 3) and got["g"]["prd"] == pytest.approx(1.0)
    assert got["h"]["prb_slope"] is None
    v = spark.createDataFrame([(float(i),) for i in range(100)] + [(10_000.0,)], "x double")
    assert ratios.trim(v, "x").agg(F.max("x")).first()[0] == 99.0
    many = spark.createDataFrame([(float(i),) for i in range(50)] + [(1e6 + i,) for i in range(10)], "x double")
    assert ratios.trim(many, "x").count() >= 56


def test_neighbours_against_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.gauss(0, 1) ** 3, rnd.gauss(0, 1), float(i)) for i in range(300)] + [(900, 0.0, 0.0, 1.0), (901, 0.0, 0.0, 2.0), (902, None, 1.0, 1.0), (903, 50.0, 50.0, 1.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double, v double")
    got = {}
    for r in neighbors.k_nearest(df, df.withColumnRenamed("id", "sid"), "id", "sid", "x", "y", 4, skip_same=True).collect():
        got.setdefault(r["id"], []).append((r["place"], r["sid"]))
    good = [p for p in pts if p[1] is not None]
    for i, x, y, _ in good:
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b, _ in good if j != i)[:4]
        assert [s for _, s in sorted(got[i])] == [j for _, j in want]
    lag = {r["id"]: r["lag_v"] for r in neighbors.spatial_lag(df, df.withColumnRenamed("id", "sid"), "id", "sid", "x", "y", ["v"], 1, skip_same=True).collect()}
    assert lag[900] == 2.0 and lag[901] == 1.0
    assert neighbors.k_nearest(df, df.limit(0).withColumnRenamed("id", "sid"), "id", "sid", "x", "y", 2).count() == 0
    few = neighbors.k_nearest(df.where("id < 3"), df.where("id < 2").withColumnRenamed("id", "sid"), "id", "sid", "x", "y", 5)
    assert few.count() == 6


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else None, i - 20) for i in range(200)], "id long, g string, age int")
    s = split.stratified(df, "id", ["g"], 0.2)
    assert {(r["g"], r["n"]) for r in s.where("split = 'test'").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 30), (None, 10)}
    assert sorted(s.where("split = 'test'").select("id").collect()) == sorted(split.stratified(df.repartition(3), "id", ["g"], 0.2).where("split = 'test'").select("id").collect())
    t = split.three_tier(df, "id", ["g"], "age", 50, 0.3).collect()
    assert all(r["split"] == "test" for r in t if r["age"] < 0) and sum(r["split"] == "test" for r in t) == 60
    for args, want in (((53, 75, 188), 53), ((20, 0, 10), 0), ((120, 50, 10), 50), ((44, 20, 200, 15, 0.5), 15)):
        assert split.lookback_size(*args) == want


def test_income_and_lots(spark):
    one = spark.range(1)
    n = income.noi(F.lit(1_000_000.0), F.lit(0.05))
    entry, exit_ = income.prices(F.lit(0.1), F.lit(0.08), F.lit(100.0), F.lit(0.02), 5)
    r = one.select(n.alias("n"), entry.alias("e"), exit_.alias("x"), income.irr(entry, exit_, F.lit(100.0) / entry, F.lit(0.02), 5).alias("irr"), income.irr(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 3).alias("none")).first()
    assert r["n"] == 50_000 and r["irr"] == pytest.approx(0.1, abs=1e-9) and r["none"] is None
    depths = [0, 10, 20, 50, 100, 125, 250]
    got = [x[0] for x in spark.createDataFrame([(float(v),) for v in depths], "d double").coalesce(1).select(planar.depth_percent(F.col("d"))).collect()]
    assert got == pytest.approx([0, 0.255, 0.415, 0.726, 1, 1.08, 1.263], abs=0.01)
