"""Returns and growth rates by bisection."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import income


def test_roots_of_many_rows(spark):
    """Rows by the hundred thousand are searched in seconds."""
    df = spark.range(0, 200_000, 1, 1).select(((F.col("id") % 200) / 1000.0).alias("g"), (50.0 + F.col("id") % 7).alias("n"), (0.05 + (F.col("id") % 11) / 100.0).alias("r"))
    entry, exit_ = income.prices(F.col("r"), F.lit(0.07), F.col("n"), F.col("g"), 5)
    p = df.withColumns({"entry": entry, "exit": exit_}).withColumn("cap", F.col("n") / F.col("entry"))
    got = p.select("g", "r", income.irr(F.col("entry"), F.col("exit"), F.col("cap"), F.col("g"), 5).alias("irr"), income.implied_growth(F.col("r"), F.lit(0.07), F.col("entry"), F.col("cap"), 5).alias("growth"))
    began = time.time()
    far = got.agg(F.max(F.abs(F.col("irr") - F.col("r"))).alias("a"), F.max(F.abs(F.col("growth") - F.col("g"))).alias("b"), F.count("irr").alias("n")).first()
    assert time.time() - began < 25
    assert far["n"] == 200_000 and far["a"] < 1e-10 and far["b"] < 1e-10


def test_no_root(spark):
    null, one = F.lit(None).cast("double"), spark.range(1)
    cases = [(100.0, 0.0, 0.0), (0.0, 0.0, 0.0), (float("nan"), 100.0, 0.05), (None, 100.0, 0.05), (1e6, 1.0, 1e-9)]
    df = spark.createDataFrame(cases, "entry double, exit double, cap double").coalesce(1)
    assert [r[0] for r in df.select(income.irr(F.col("entry"), F.col("exit"), F.col("cap"), F.lit(0.02), 3)).collect()] == [None] * 5
    r = one.select(income.irr(F.lit(100.0), F.lit(100.0), F.lit(0.1), F.lit(0.0), 1).alias("a"), income.implied_growth(F.lit(0.1), null, F.lit(1.0), F.lit(0.1), 3).alias("b"), income.implied_growth(F.lit(0.1), F.lit(0.0), F.lit(1.0), F.lit(0.1), 3).alias("c")).first()
    assert r["a"] == pytest.approx(0.1, abs=1e-12) and r["b"] is None and r["c"] is None
