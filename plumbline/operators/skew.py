"""Equality joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.lastknown import HOT_ROWS, HOT_SHARE, hot_keys

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS, hot: list | None = None) -> DataFrame:
    """``left.join(right, key, how)`` (inner, left, left_semi or left_anti) with the left rows of hot keys spread over
    salts, and only those keys' right rows repeated. Null keys match nothing; with ``left`` they stay. ``hot``: the hot
    keys, where they were counted already."""
    hot = hot_keys(left, key, hot_share, hot_rows) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    plain = [c for c in left.columns if c != key]
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], how).drop("__salt")


#: Rows up to which a table may be sent to all tasks.
SMALL_ROWS = 100_000


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int = SMALL_ROWS, counted: int | None = None) -> DataFrame:
    """``left.join(right, key, how)``: ``right``, a table of words or the like, is broadcast if it is counted to have at most
    ``rows`` rows; else both are shuffled, hot keys of ``left`` salted. ``counted``: its rows, or more, where they were counted already."""
    if (right.limit(rows + 1).count() if counted is None else counted) <= rows:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, how)


def small(df: DataFrame, counted: int, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` to be broadcast if it was counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if counted <= rows else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which a null key equals a null key. The right keys are renamed first, so both sides may stem from one table."""
    r = right.select(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    return left.join(r, same, how).drop(*[f"__key_{i}" for i in range(len(keys))])


#: Bits of the filter of known keys: 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25
FILTER_HASHES = 3


def maybe_known(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A condition on rows of ``df``: whether ``key`` may be in the first column of ``keys``. True for all that are, and for some others.

    A Bloom filter of fixed size, so what is collected and broadcast (``bits / 64`` numbers) does not grow with the
    keys; it thins out wide rows before they are shuffled for an exact join. False for null keys.
    """
    import numpy as np

    name = keys.columns[0]
    places = lambda c: F.array(*[F.xxhash64(c.cast(dict(df.dtypes)[key]), F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(FILTER_HASHES)])
    at = keys.where(F.col(name).isNotNull()).select(F.explode(places(F.col(name))).alias("p"))
    words = at.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words["w"].to_numpy()] = words["b"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    @F.pandas_udf("boolean")
    def known(*columns):
        import numpy as np
        import pandas as pd

        out = np.ones(len(columns[0]), bool)
        for c in columns:
            p = c.to_numpy()
            out &= ((sent.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    p = places(F.col(f"`{key}`"))
    return F.col(f"`{key}`").isNotNull() & known(*[p[i] for i in range(FILTER_HASHES)])


#: Rows ranked in one task.
RANK_ROWS = 100_000


def hash_rank(df: DataFrame, by: list[str], key: str, seed: int, out: str, rows: int = RANK_ROWS) -> DataFrame:
    """``out``: the place (from 1) of each row in its group in the order of a seeded hash of ``key``, then ``key``.

    A group is ranked in buckets of the hash's range, so that one of any size is spread over tasks; a bucket's place
    is the number of rows in the buckets before it. Null groups are groups.
    """
    n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).alias("__b"))
    h = F.xxhash64(F.col(f"`{key}`"), F.lit(seed))
    # the upper half of the hash as a share of its range, so buckets follow the order of the hash
    share = (F.shiftright(h, 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    d = null_safe_join(df.withColumn("__h", h).withColumn("__u", share), n, by).withColumn("__k", F.floor(F.col("__u") * F.col("__b")))
    sizes = d.groupBy(*by, "__k").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*by, "__k").orderBy("__h", key))
    got = null_safe_join(d.withColumn("__r", place), before, [*by, "__k"])
    return got.withColumn(out, F.col("__r") + F.col("__before")).drop("__h", "__u", "__b", "__k", "__r", "__before")
