"""Combining tables: merges with reconciliation, keyed updates, lookups, key sets.

All of it is equality joins and coalesce, so Catalyst chooses broadcast, hash or sort-merge and AQE splits skew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ParcelSales:
    """A parcel table (one row per ``key``) and its sales (one row per ``key_sale``, foreign key ``key``); never changed in place."""

    universe: DataFrame
    sales: DataFrame

    def with_universe(self, df: DataFrame) -> ParcelSales:
        return replace(self, universe=df)

    def with_sales(self, df: DataFrame, may_drop: bool = False) -> ParcelSales:
        """New sales that may add columns, and with ``may_drop`` leave out rows; existing columns keep their values."""
        added = [c for c in df.columns if c not in self.sales.columns]
        news = df.select("key_sale", *added)
        return replace(self, sales=self.sales.join(news, "key_sale", "inner" if may_drop else "left"))

    def limited_to(self, keys: DataFrame) -> ParcelSales:
        """Only sales whose ``key_sale`` is in ``keys``."""
        return replace(self, sales=self.sales.join(keys.select("key_sale"), "key_sale", "left_semi"))

    def hydrated(self) -> DataFrame:
        """Sales with their parcel's columns; a sale's own value wins where it has one."""
        return stomp(self.sales, self.universe, "key", right_wins=False)

    def of_group(self, group: str) -> ParcelSales:
        """The parcels of a model group and the sales whose hydrated group it is."""
        mine = self.hydrated().where(F.col("model_group") == group).select("key_sale")
        return ParcelSales(self.universe.where(F.col("model_group") == group), self.sales.join(mine, "key_sale", "left_semi"))


def merge(tables: list[tuple[str, DataFrame]], steps: list[dict], reconcile: dict[str, list[str]] | None = None, key: str = "key") -> DataFrame:
    """Joins tables in order. A step is ``{"id", "how", "on" | "left_on"/"right_on"}``; ``how: append`` unites by name.

    A column that exists already comes in as ``<column>_<id>``; afterwards it is the first non-null of the base and the
    clashing ones, in the order of the steps or of ``reconcile[column]`` (ids). Rows without ``key`` are dropped.
    """
    by_id = dict(tables)
    first, *rest = steps
    out = by_id[first["id"]]
    clashes: dict[str, list[str]] = {}
    for step in rest:
        right = by_id[step["id"]]
        if step.get("how") == "append":
            out = out.unionByName(right, allowMissingColumns=True)
            continue
        on = step.get("on", key)
        on = [on] if isinstance(on, str) else on
        left_on, right_on = step.get("left_on", on), step.get("right_on", on)
        left_on, right_on = ([x] if isinstance(x, str) else x for x in (left_on, right_on))
        names = {}
        for c in right.columns:
            if c in right_on:
                names[c] = left_on[right_on.index(c)]
            elif c in out.columns:
                names[c] = f"{c}_{step['id']}"
                clashes.setdefault(c, []).append(names[c])
            else:
                names[c] = c
        out = out.join(right.select(*[F.col(c).alias(n) for c, n in names.items()]), left_on, step.get("how", "left"))
    for c, extra in clashes.items():
        if reconcile and c in reconcile:
            extra = [f"{c}_{i}" for i in reconcile[c] if f"{c}_{i}" in extra]
        out = out.withColumn(c, F.coalesce(F.col(c), *[F.col(x) for x in extra]))
    return out.drop(*[x for extra in clashes.values() for x in extra]).where(F.col(key).isNotNull())


def stomp(left: DataFrame, right: DataFrame, on: str, right_wins: bool = False, how: str = "left") -> DataFrame:
    """A join in which common columns become the first non-null value, the winner's first."""
    common = [c for c in left.columns if c in right.columns and c != on]
    got = left.join(right.select(on, *[F.col(c).alias(f"__r_{c}") if c in common else F.col(c) for c in right.columns if c != on]), on, how)
    both = lambda c: (F.col(f"__r_{c}"), F.col(c)) if right_wins else (F.col(c), F.col(f"__r_{c}"))
    return got.withColumns({c: F.coalesce(*both(c)) for c in common}).drop(*[f"__r_{c}" for c in common])


def keyed_update(left: DataFrame, right: DataFrame, on: str, overwrite: bool = False) -> DataFrame:
    """All rows of ``left``. Where ``right`` has the key, common columns take its value (nulls too) with ``overwrite``,
    else only where ``left`` has none; further columns are added."""
    common = [c for c in left.columns if c in right.columns and c != on]
    r = right.select(on, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__r_{c}") if c in common else F.col(c) for c in right.columns if c != on])
    got = left.join(r, on, "left")
    pick = lambda c: F.when(F.col("__hit"), F.col(f"__r_{c}")).otherwise(F.col(c)) if overwrite else F.coalesce(c, f"__r_{c}")
    return got.withColumns({c: pick(c) for c in common}).drop("__hit", *[f"__r_{c}" for c in common])


def lookup(df: DataFrame, ref: DataFrame, key: str, ref_key: str, fields: list[str]) -> DataFrame:
    """Adds ``fields`` of a reference table with unique ``ref_key``; existing fields are an error."""
    if clash := [f for f in fields if f in df.columns]:
        raise ValueError(f"columns exist already: {clash}")
    return df.join(ref.select(F.col(ref_key).alias(key), *fields), key, "left")


def fill_from(df: DataFrame, other: DataFrame, key: str, field: str) -> DataFrame:
    """``field`` filled from another table where it is null."""
    return stomp(df, other.select(key, field), key)


def having(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def lacking(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def append(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def match_counts(a: DataFrame, b: DataFrame, a_field: str, b_field: str) -> DataFrame:
    """One row: distinct values on each side, and how many of each the other side has."""
    x, y = a.select(F.col(a_field).alias("v")).where("v is not null").distinct(), b.select(F.col(b_field).alias("v")).where("v is not null").distinct()
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "v", "full")
    return both.agg(F.count("a").alias("distinct_a"), F.count("b").alias("distinct_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("in_both"))
