"""Queries of readers, synthetic tables, histograms and windowed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import settings
from plumbline.plans.registry import Family
from plumbline.plans.tables import table
from plumbline.sources import readers, synthetic, writers
from plumbline.streaming import windows

family = Family()
query = family.query


@query("""SELECT key, sale_id, CASE model_group WHEN 'condo' THEN 'C' ELSE model_group END AS grp, price, round(price / 2, 4) AS half
FROM (SELECT key, row_id AS sale_id, model_group, CASE WHEN NOT isnan(sale_price) THEN sale_price END AS price FROM sales QUALIFY row_number() OVER (PARTITION BY key_sale ORDER BY row_id) = 1)""")
def load_table(spark, d):
    entry = {
        "filename": "sales.parquet", "load": {"key": "key", "sale_id": "row_id", "grp": "model_group", "price": ["sale_price", "double"], "key_sale": "key_sale"},
        "calc": {"half": ["/", "price", 2]}, "calc_2": {"grp": ["map", "grp", {"condo": "C"}]},
        "dupes": {"subset": ["key_sale"], "sort_by": ["sale_id"]}, "drop": ["key_sale"],
    }
    return settings.load_table(spark, entry, d).withColumn("half", F.round("half", 4))


@query("SELECT lpad((c_nationkey % 50)::VARCHAR, 2, '0') || lpad((c_custkey % 999)::VARCHAR, 3, '0') || lpad((c_custkey * 7 % 999999)::VARCHAR, 6, '0') || (c_custkey % 9)::VARCHAR AS std_geoid, c_custkey FROM customer")
def geoid_concat(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 50).alias("state"), (k % 999).alias("county"), (k * 7 % 999999).alias("tract"), (k % 9).alias("block_group"))
    return readers.census_geoid(df).select("std_geoid", "c_custkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS height, CASE WHEN p_partkey % 3 = 1 THEN p_size * 1.5::DOUBLE END AS est_height, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS num_floors FROM part), h AS (SELECT *, coalesce(height, est_height, num_floors * 3.2::DOUBLE) AS height_best FROM p)
SELECT p_partkey, height_best, coalesce(num_floors::DOUBLE, CASE WHEN height_best IS NOT NULL THEN greatest(1, round_even(height_best / 3.2, 0)) END)::DOUBLE AS floors_best FROM h""")
def building_heights(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("height"), F.when(k % 3 == 1, F.col("p_size") * 1.5).alias("est_height"), F.when(k % 2 == 0, F.col("p_size")).alias("num_floors"))
    return readers.with_heights(p).select("p_partkey", "height_best", "floors_best")


@query("SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS name_clean FROM part WHERE p_size >= 30 OR p_retailprice >= 1500")
def feature_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("area"), F.col("p_retailprice").alias("length"))
    return readers.features(p, 30, 1500).select("p_partkey", "name_clean")


@query("SELECT (CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, d):
    return writers.histogram(table(spark, d, "orders"), "o_totalprice", 0, 500000, 20)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    got = windows.windowed(table(spark, d, "events"), "ts", ["event_type"], "value")
    return got.drop("median").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


@query()
def streamed_events(spark, d):
    """The windowed statistics through a stream over the same file."""
    import uuid

    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return windows.run_once(windows.windowed(s, "ts", ["event_type"], "value"), f"streamed_{uuid.uuid4().hex}")


@query()
def synthetic_sales(spark, d):
    u = synthetic.parcels(spark, 60)
    return synthetic.sales(u, synthetic.inflation(spark, "2020-01-01", "2024-12-31"))
