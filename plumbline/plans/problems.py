"""Queries of the general training-data problems: p2 (near points and regions) and p5 (attributes as known at event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.lastknown import as_known_at
from plumbline.operators.spatial import found_near_and_inside
from plumbline.plans.tables import table

STATUS_ATTRIBUTES = ["is_vacant", "bldg_area_finished_sqft", "assr_market_value", "zoning", "feed"]


def statuses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parcel_status").unionByName(table(spark, d, "state_roll_status"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return found_near_and_inside(table(spark, d, "universe"), table(spark, d, "block_groups"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "sales").select("row_id", "key", "sale_date")
    got = as_known_at(sales, statuses(spark, d), "key", "sale_date", "effective_date", "recorded_at", "status_id", STATUS_ATTRIBUTES, version="status_id")
    return got.where(F.col("status_id").isNotNull()).select("row_id", "status_id")


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "sales").select("row_id", "key", "sale_date", "vacant_sale")
    got = as_known_at(sales, statuses(spark, d), "key", "sale_date", "effective_date", "recorded_at", "status_id", STATUS_ATTRIBUTES)
    got = got.select("row_id", "key", "vacant_sale", *[F.col(f"known_{a}").alias(a) for a in STATUS_ATTRIBUTES], F.col("known_is_vacant_id").alias("is_vacant_status_id"))
    return got.withColumn("vacant_at_sale", F.coalesce("is_vacant", "vacant_sale"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_attributes": p5_attributes}

_VERSIONS = """
WITH v AS (SELECT * FROM parcel_status UNION ALL BY NAME SELECT * FROM state_roll_status),
j AS (SELECT s.row_id, s.key, s.vacant_sale, v.* EXCLUDE (key) FROM sales s
      JOIN v ON v.key = s.key AND v.effective_date <= s.sale_date AND v.recorded_at <= s.sale_date)
"""
_LAST = "ORDER BY effective_date DESC, recorded_at DESC, status_id DESC"
SQL = {
    "p5_found": _VERSIONS + f"SELECT row_id, status_id FROM j QUALIFY row_number() OVER (PARTITION BY row_id {_LAST}) = 1",
    "p5_attributes": _VERSIONS
    + ", k AS (SELECT row_id, "
    + ", ".join(f"list({a} {_LAST}) FILTER ({a} IS NOT NULL{f' AND NOT isnan({a})' if a in ('bldg_area_finished_sqft', 'assr_market_value') else ''})[1] AS {a}" for a in STATUS_ATTRIBUTES)
    + f", list(status_id {_LAST}) FILTER (is_vacant IS NOT NULL)[1] AS is_vacant_status_id FROM j GROUP BY row_id)"
    + " SELECT s.row_id, s.key, s.vacant_sale, "
    + ", ".join(f"k.{a}" for a in STATUS_ATTRIBUTES)
    + ", k.is_vacant_status_id, coalesce(k.is_vacant, s.vacant_sale) AS vacant_at_sale FROM sales s LEFT JOIN k ON k.row_id = s.row_id",
}
