"""Synthetic parcels and sales on a grid, made in parallel from row numbers (values are a function of the seed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, *what) -> F.Column:
    """A number in [0, 1) from a seed and columns; the same on any number of partitions."""
    return F.pmod(F.xxhash64(*what, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def parcels(spark: SparkSession, size: int, seed: int = 1337, vacant_share: float = 0.1) -> DataFrame:
    """A ``size`` x ``size`` grid of parcels about a centre, with areas, quality, values and neighbourhoods."""
    base = spark.range(size * size).select((F.col("id") % size).alias("x"), F.floor(F.col("id") / size).alias("y"))
    key = F.concat_ws("-", "x", "y")
    d = F.hypot(F.col("x") - size / 2, F.col("y") - size / 2) / (size / 2)
    draw = lambda k: _draw(seed + k, key)
    hood = F.concat_ws("_", F.when(d < 0.33, "urban").when(d < 0.66, "suburban").otherwise("rural"), F.when(F.col("x") < size / 2, F.when(F.col("y") < size / 2, "nw").otherwise("sw")).otherwise(F.when(F.col("y") < size / 2, "ne").otherwise("se")))
    u = base.select(key.alias("key"), "x", "y", hood.alias("neighborhood"), d.alias("dist_to_cbd"), (draw(1) < vacant_share).alias("is_vacant"), (4000 + draw(2) * 6000).cast("long").alias("land_area_sqft"), (29.7 + F.col("y") * 0.001).alias("latitude"), (-95.4 + F.col("x") * 0.001).alias("longitude"), draw(3).alias("q"), draw(4).alias("c"), (draw(5) * 80).alias("age"))
    u = u.withColumns({"bldg_area_finished_sqft": F.when(F.col("is_vacant"), 0).otherwise((800 + F.col("q") * 2400).cast("long")), "bldg_quality_num": F.when(F.col("is_vacant"), 0.0).otherwise(1 + 5 * F.col("q")), "bldg_condition_num": F.when(F.col("is_vacant"), 0.0).otherwise(1 + 5 * F.col("c")), "bldg_age_years": F.when(F.col("is_vacant"), 0.0).otherwise(F.col("age"))})
    u = u.withColumns({"land_value": F.col("land_area_sqft") * 20 * F.greatest(F.lit(0.05), 1 - F.col("dist_to_cbd")), "bldg_value": F.col("bldg_area_finished_sqft") * 100 * (0.5 + F.col("q")) * F.exp(-F.col("bldg_age_years") / 100)})
    return u.withColumn("total_value", F.col("land_value") + F.col("bldg_value")).drop("q", "c", "age")


def inflation(spark: SparkSession, start: str, end: str, annual: float = 0.05) -> DataFrame:
    """``period, value``: a daily index that compounds at the annual rate."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("period"))
    return days.select("period", F.pow(F.lit(1 + annual), F.datediff("period", F.lit(start).cast("date")) / 365.25).alias("value"))


def depreciation(age: F.Column, lifetime: float, linear: float = 0.5, steepness: float = 8.0) -> F.Column:
    """A share of value left by age: a mix of a straight line and a logistic curve."""
    t = F.least(F.lit(1.0), age / lifetime)
    return F.greatest(F.lit(0.0), linear * (1 - t) + (1 - linear) / (1 + F.exp(F.lit(steepness) * (t - 0.5))))


def sales(universe: DataFrame, index: DataFrame, share: float = 0.1, seed: int = 1337, noise: float = 0.05) -> DataFrame:
    """One sale for ``share`` of the parcels on a day of ``index``, priced at value x index with noise."""
    day = index.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    s = universe.where(_draw(seed + 11, F.col("key")) < share).crossJoin(F.broadcast(day))
    s = s.withColumn("period", F.date_add("a", F.floor(_draw(seed + 12, F.col("key")) * (F.datediff("b", "a") + 1)).cast("int"))).join(index, "period")
    price = F.col("total_value") * F.col("value") * (1 + noise * (2 * _draw(seed + 13, F.col("key")) - 1))
    return s.select("key", F.concat_ws("---", "key", F.date_format("period", "yyyy-MM-dd")).alias("key_sale"), F.lit(True).alias("valid_sale"), F.col("is_vacant").alias("vacant_sale"), price.alias("sale_price"), F.col("period").cast("timestamp").alias("sale_date"))


def income_sales(spark: SparkSession, per_year: int, first: int, last: int, noi: float = 100_000.0, growth: float = 0.02, cap_rate: float = 0.07, seed: int = 7) -> DataFrame:
    """``year, sale, noi, cap_rate, price``: income growing by year, capitalised with spread."""
    base = spark.range((last - first + 1) * per_year).select((F.floor(F.col("id") / per_year) + first).alias("year"), (F.col("id") % per_year).alias("sale"))
    n = F.lit(noi) * F.pow(F.lit(1 + growth), F.col("year") - first) * (0.9 + 0.2 * _draw(seed, F.col("year"), F.col("sale")))
    c = F.lit(cap_rate) * (0.95 + 0.1 * _draw(seed + 1, F.col("year"), F.col("sale")))
    return base.withColumns({"noi": n, "cap_rate": c}).withColumn("price", F.col("noi") / F.col("cap_rate"))
