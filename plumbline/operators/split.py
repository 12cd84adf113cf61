"""Deterministic train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import hash_rank, null_safe_join


def lookback_size(test: int, lookback: int, other: int, floor: int = 0, cap: float = 1.0) -> int:
    """How many test rows come from the look-back window: all wanted ones, at most the window's share ``cap`` of its rows,
    at least ``floor`` where the window has them, and never more than the window holds."""
    if lookback <= 0:
        return 0
    most = max(int(lookback * cap), min(floor, lookback))
    return max(0, min(test, most, lookback))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1e6


def hash_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``split`` = test or train by the key's hash; no shuffle, rows of one key stay together."""
    return df.withColumn("split", F.when(hash_share(F.col(key), seed) < share, "test").otherwise("train"))


def stratified(df: DataFrame, key: str, strata: list[str], share: float, seed: int = 42) -> DataFrame:
    """``split`` with ``round(share x n)`` test rows in every stratum, in seeded hash order (then by key)."""
    ranked = hash_rank(df, strata, key, seed, "__place")
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    return null_safe_join(ranked, n, strata).withColumn("split", F.when(F.col("__place") <= F.round(F.col("__n") * share), "test").otherwise("train")).drop("__place", "__n")


def three_tier(df: DataFrame, key: str, by: list[str], age_days: str, lookback_days: int, share: float, seed: int = 42, cap: float = 0.5) -> DataFrame:
    """``split``: rows after the valuation date (negative age) are test; then rows of the look-back window in seeded order, up
    to ``cap`` of it; then older rows, until ``share`` of the group is test. Null ages count as older."""
    tier = F.when(F.col(age_days) < 0, 0).when(F.col(age_days) <= lookback_days, 1).otherwise(2)
    t = df.withColumn("__tier", tier)
    n = t.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__tier") == 0).alias("__n0"), F.count_if(F.col("__tier") == 1).alias("__n1"))
    n = n.withColumn("__want", F.greatest(F.lit(0), F.round(F.col("__n") * share) - F.col("__n0")))
    n = n.withColumn("__from1", F.least("__want", F.floor(F.col("__n1") * cap))).withColumn("__from2", F.col("__want") - F.col("__from1"))
    j = null_safe_join(hash_rank(t, [*by, "__tier"], key, seed, "__place"), n, by)
    place = F.col("__place")
    test = (F.col("__tier") == 0) | ((F.col("__tier") == 1) & (place <= F.col("__from1"))) | ((F.col("__tier") == 2) & (place <= F.col("__from2")))
    return j.withColumn("split", F.when(test, "test").otherwise("train")).drop("__tier", "__n", "__n0", "__n1", "__want", "__from1", "__from2", "__place")
