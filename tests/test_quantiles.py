"""Quantiles and resampling that hold no group in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import predict, quantiles, ratios


def test_poisson_weights_are_whole():
    w = ratios.poisson_weights(np.random.default_rng(1), 200_000, 20)
    n = np.bincount(w.ravel(), minlength=9) / w.size
    want = [0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307, 0.00051, 0.000073]
    assert n[:8] == pytest.approx(want, abs=4e-4) and n[7] == pytest.approx(want[7], abs=2e-5) and n[8:].sum() > 0


def test_bootstrap_holds_values_near_the_median_only(spark):
    df = spark.range(20_000).select(F.lit(1.0).alias("t"), (0.5 + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("p"))
    r = ratios.with_ratio(df, "p", "t").select("ratio")
    whole, _ = ratios._replicates(r, None, 50, 7)
    near, held = ratios._replicates(r, (0.9, 1.1), 50, 7)
    assert held and np.allclose(*(sorted(map(tuple, x.collect())) for x in (whole, near)), rtol=1e-12)
    assert not ratios._replicates(r, (0.2, 0.3), 50, 7)[1] and not ratios._replicates(r, (1.2, 1.3), 50, 7)[1]
    a, b = (sorted(map(tuple, ratios.bootstrap(df, "p", "t", 50, few=f).collect())) for f in (10, 10**9))
    assert np.allclose(*([y[1:] for y in x] for x in (a, b)), rtol=1e-12) and [x[0] for x in a] == ["mean", "median"]
    assert all(x[1] < 1 < x[2] and x[2] - x[1] < 0.04 for x in a)
    none = ratios.bootstrap(df.where("t > 1"), "p", "t", 5).collect()
    assert [tuple(x)[1:] for x in none] == [(None, None)] * 2


def test_exact_quantiles(spark):
    """Brackets change the work only: the values are those of the interpolation over all rows, for groups of all kinds."""
    rnd = np.random.default_rng(3)
    groups = {"a": rnd.normal(size=5000), "b": np.repeat([1.0, 2.0], [700, 801]), "c": 1 + 1e-12 * rnd.random(3000), None: -np.exp(rnd.normal(size=999) * 20), "d": np.array([5.0]), "e": np.array([1.0, np.inf, np.inf])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)], "g string, v double")
    probs = [0.5, 0.0, 0.25, 0.999, 1.0, 0.025]
    for few, width in ((100_000, 0.001), (100, 0.01), (0, 1e-6)):
        got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact(df, ["g"], "v", probs, width=width, few=few).collect()}
        want = {r["g"]: (r["n"], r["q"]) for r in df.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", probs).alias("q")).collect()}
        assert got == want
    assert quantiles.exact(df, [], "v", [0.5], few=10).first()["q"] == df.agg(F.percentile("v", [0.5])).first()[0]
    assert tuple(quantiles.exact(df.where("v is null"), [], "v", [0.5, 1.0]).first()) == (0, [None, None])
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert quantiles.median(nan, [], "v", "m").first()["m"] == 2.0


def test_no_map_of_all_values(spark):
    """Medians of rates are not gathered in one task's map of distinct values."""
    df = spark.range(2000).select(F.col("id").cast("double").alias("y"), F.lit(2.0).alias("a"), (F.col("id") % 3).alias("h"))
    plan = predict.local_area(df, df, "y", "a", ["h"])._jdf.queryExecution().toString().lower()
    assert "median" not in plan and "percentile(" not in plan
    got = predict.local_area(df, df, "y", "a", [])
    assert got.agg(F.max("prediction")).first()[0] == 2 * (1999 / 2 / 2)


def test_medians_in_common_passes(spark):
    """Medians of several groupings are those of all values, whatever the buckets, and are found together."""
    rnd = np.random.default_rng(4)
    groups = {"a": rnd.normal(size=2000), "b": np.repeat([1.0, 2.0], [700, 700]), "c": 1 + 1e-12 * rnd.random(999), None: -np.exp(rnd.normal(size=999) * 20), "d": [5.0], "e": [1.0, np.inf, np.inf], "h": [2.0, np.nan, 3.0], "i": [np.nan], "j": [5e-324, 2e-323, 1e308, 1.7e308]}
    df = spark.createDataFrame([(g, i % 3 if i % 7 else None, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", 1, None), ("f", 9, None)], "g string, t int, v double").repartition(2)
    groupings = [["g"], ["t"], ["g", "t"], []]
    for octave, parts, held in ((32, 4096, 500_000), (4, 64, 10)):
        for by, got in zip(groupings, quantiles.medians(df, groupings, "v", list("wxyz"), octave, parts, held), strict=True):
            want = df.where(" and ".join(f"{c} is not null" for c in [*by, "v"])).groupBy(*by).agg(F.percentile("v", 0.5))
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert [x.collect() for x in quantiles.medians(df.where("v is null"), [["g"], []], "v", ["x", "y"])] == [[], [(None,)]]


def test_local_area_in_few_jobs(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("y"), F.lit(2.0).alias("a"), (F.col("id") % 3).alias("h"), (F.col("id") % 5).alias("k"))
    spark.sparkContext.setJobGroup("local_area", "")
    predict.local_area(df, df, "y", "a", ["h", "k"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("local_area")) < 30


def test_trimmed_study_without_maps(spark):
    """Bounds and medians are found at once: the plans of what comes out hold no aggregate of all values."""
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.lit(1.0).alias("t"), F.when(F.col("id") < 30, 50.0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0).alias("p"))
    kept = ratios.trim(ratios.with_ratio(df, "p", "t"), "ratio")
    plan = kept._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and kept.count() == 2970 and kept.agg(F.max("ratio")).first()[0] < 2
    a, b = (sorted(map(tuple, ratios.ratio_study(kept.drop("ratio"), ["g"], "p", "t", exact=e).collect())) for e in (False, True))
    assert np.allclose(a, b, rtol=1e-12)
