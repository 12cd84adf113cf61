"""Queries of windows, bins, top-k, time series and date-offset joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import asof, bins, series
from plumbline.plans.registry import Family
from plumbline.plans.tables import table

family = Family()
query = family.query


@query("""WITH r AS (SELECT l_orderkey, l_extendedprice, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_quantity) AS r FROM lineitem)
SELECT l_orderkey, max(l_extendedprice) FILTER (r = 1) AS l_extendedprice_1, max(l_partkey) FILTER (r = 1) AS l_partkey_1, max(l_extendedprice) FILTER (r = 2) AS l_extendedprice_2, max(l_partkey) FILTER (r = 2) AS l_partkey_2,
max(l_extendedprice) FILTER (r = 3) AS l_extendedprice_3, max(l_partkey) FILTER (r = 3) AS l_partkey_3, max(l_extendedprice) FILTER (r = 4) AS l_extendedprice_4, max(l_partkey) FILTER (r = 4) AS l_partkey_4 FROM r WHERE r <= 4 GROUP BY 1""")
def topk_per_group_pivot(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_quantity")
    return bins.top_pivot(df, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_quantity")], 4, ["l_extendedprice", "l_partkey"])


@query("""SELECT record_id, CASE WHEN land_area_sqft IS NOT NULL THEN (rank() OVER (PARTITION BY neighborhood, land_area_sqft IS NULL ORDER BY land_area_sqft) + (count(*) OVER (PARTITION BY neighborhood, land_area_sqft) - 1) / 2.0)
/ count(land_area_sqft) OVER (PARTITION BY neighborhood) END::DOUBLE AS pct FROM universe""")
def rank_pct(spark, d):
    return bins.rank_share(table(spark, d, "universe").select("record_id", "neighborhood", "land_area_sqft"), ["neighborhood"], "land_area_sqft", "pct").select("record_id", "pct")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_type) AS cluster FROM part")
def group_ids(spark, d):
    return bins.group_ids(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "cluster").select("p_partkey", F.col("cluster").cast("long").alias("cluster"))


@query("SELECT record_id, land_area_sqft / sum(land_area_sqft) OVER (PARTITION BY census_block_group) AS share FROM universe")
def share_of_group(spark, d):
    return bins.share_of_group(table(spark, d, "universe").select("record_id", "census_block_group", "land_area_sqft"), ["census_block_group"], "land_area_sqft", "share").select("record_id", "share")


@query("""WITH e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM orders)
SELECT o_orderkey, greatest(1, len(list_filter(e, lambda x: x < o_totalprice)))::INT AS decile FROM orders, e""")
def qcut_bins(spark, d):
    return bins.quantile_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "decile").select("o_orderkey", "decile")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 10000 THEN NULL WHEN c_acctbal <= 1000 THEN 1 WHEN c_acctbal <= 5000 THEN 2 ELSE 3 END::INT AS bin,
CASE WHEN c_acctbal IS NOT NULL THEN (floor(c_acctbal / 2500) * 2500)::BIGINT::VARCHAR || ' - ' || (floor(c_acctbal / 2500) * 2500 + 2500)::BIGINT::VARCHAR END AS slice FROM customer""")
def slice_bins(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", bins.fixed_bins(b, [0, 1000, 5000, 10000]).alias("bin"), bins.slice_label(b, 2500).alias("slice"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def nlargest(spark, d):
    return bins.largest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS p FROM orders) SELECT DISTINCT * FROM ((SELECT * FROM o ORDER BY p, o_orderkey LIMIT 10) UNION ALL (SELECT * FROM o ORDER BY p DESC, o_orderkey LIMIT 10)
UNION ALL SELECT * FROM o WHERE p < 2000 OR p > 450000)""")
def extremes_union(spark, d):
    return bins.extremes(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p")), "p", "o_orderkey", 10, 2000, 450000)


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def idxmin_first_hit(spark, d):
    return bins.first_hit(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey"])


_SALES = "s AS (SELECT model_group, sale_year_month AS month, sale_date, sale_price AS p, row_id FROM sales WHERE sale_price > 0 AND NOT isnan(sale_price) AND valid_sale AND model_group IS NOT NULL AND sale_date >= TIMESTAMP '2000-01-01')"


def _sales(spark, d):
    s = table(spark, d, "sales").where("sale_price > 0 and not isnan(sale_price) and valid_sale and model_group is not null and sale_date >= timestamp '2000-01-01'")
    return s.select("model_group", F.col("sale_year_month").alias("month"), "sale_date", F.col("sale_price").alias("p"), "row_id")


@query(f"WITH {_SALES} SELECT model_group, month, count(*) AS n, median(p) AS median FROM s WHERE month IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5")
def period_medians(spark, d):
    return series.period_medians(_sales(spark, d), ["model_group"], "month", "p", 5)


_INDEX = f"""WITH {_SALES}, m AS (SELECT model_group, month, median(p) AS median FROM s WHERE month IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
e AS (SELECT model_group, min(month) AS a, max(month) AS b FROM m GROUP BY 1),
sp AS (SELECT model_group, strftime(unnest(generate_series((a || '-01')::TIMESTAMP, (b || '-01')::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM e),
w AS (SELECT sp.model_group, sp.month, median, substr(sp.month, 1, 4)::INT * 12 + substr(sp.month, 6, 2)::INT AS x FROM sp LEFT JOIN m USING (model_group, month)),
k AS (SELECT *, last_value(CASE WHEN median IS NOT NULL THEN x END IGNORE NULLS) OVER b AS px, last_value(median IGNORE NULLS) OVER b AS py, first_value(CASE WHEN median IS NOT NULL THEN x END IGNORE NULLS) OVER f AS nx, first_value(median IGNORE NULLS) OVER f AS ny FROM w
WINDOW b AS (PARTITION BY model_group ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY model_group ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT model_group, month, x, median, CASE WHEN median IS NOT NULL THEN median ELSE py + (ny - py) * ((x - px) / (nx - px)::DOUBLE) END AS filled FROM k),
idx AS (SELECT model_group, month, median, filled, last_value(filled) OVER (PARTITION BY model_group ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / filled AS factor FROM i) """


@query(_INDEX + "SELECT model_group, month, median, filled, factor FROM idx")
def index_interpolated(spark, d):
    return series.time_index(_sales(spark, d), ["model_group"], "month", "p")


@query(_INDEX + "SELECT s.row_id, s.p * coalesce(factor, 1.0) AS adjusted FROM s LEFT JOIN idx ON idx.model_group = s.model_group AND idx.month = s.month")
def adjust_prices(spark, d):
    s = _sales(spark, d)
    index = series.time_index(s, ["model_group"], "month", "p")
    return series.adjust(s, index, ["model_group"], "month", "p", "adjusted").select("row_id", "adjusted")


@query(f"""WITH RECURSIVE {_SALES}, m AS (SELECT model_group, month, median(p) AS median FROM s WHERE month IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY model_group ORDER BY month) AS i, count(*) OVER (PARTITION BY model_group) AS n, lead(median) OVER (PARTITION BY model_group ORDER BY month) AS nxt FROM m),
r AS (SELECT model_group, month, i, median, median AS smoothed FROM o WHERE i = 1
UNION ALL SELECT o.model_group, o.month, o.i, o.median, CASE WHEN o.i = o.n THEN o.median ELSE (r.smoothed + o.median + o.nxt) / 3 END FROM o JOIN r ON r.model_group = o.model_group AND o.i = r.i + 1)
SELECT model_group, month, median, round(smoothed, 6) AS smoothed FROM r""")
def smooth_recursive(spark, d):
    med = series.period_medians(_sales(spark, d), ["model_group"], "month", "p").drop("n")
    return series.smooth(med, ["model_group"], "month", "median", "smoothed").withColumn("smoothed", F.round("smoothed", 6))


@query(f"""WITH {_SALES}, m AS (SELECT model_group, month, median(p) AS median FROM s WHERE month IS NOT NULL GROUP BY 1, 2)
SELECT model_group, month, median / first_value(median) OVER (PARTITION BY model_group ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_first FROM m""")
def index_normalised(spark, d):
    med = series.period_medians(_sales(spark, d), ["model_group"], "month", "p").drop("n")
    return series.to_first(med, ["model_group"], "month", "median", "to_first").select("model_group", "month", "to_first")


@query(f"""WITH {_SALES}, m AS (SELECT model_group, avg((n < 5)::INT) AS thin_m FROM (SELECT model_group, date_trunc('month', sale_date), count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT model_group, avg((n < 5)::INT) AS thin_q FROM (SELECT model_group, date_trunc('quarter', sale_date), count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT model_group, round(thin_m, 8) AS thin_m, round(thin_q, 8) AS thin_q, CASE WHEN thin_m <= 2 / 12 THEN 'M' WHEN thin_q <= 1 / 4 THEN 'Q' ELSE 'Y' END AS resolution FROM m JOIN q USING (model_group)""")
def time_resolution(spark, d):
    return series.resolution(_sales(spark, d), ["model_group"], "sale_date", "p").withColumns({"thin_m": F.round("thin_m", 8), "thin_q": F.round("thin_q", 8)})


@query("""SELECT o_orderkey, days, l_partkey FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::INT AS days, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE days > 0
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY days, l_partkey) = 1""")
def asof_forward(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderkey", "o_orderdate")
    return asof.next_after(o, table(spark, d, "lineitem"), "l_orderkey", "o_orderkey", "o_orderdate", "l_shipdate", ["l_partkey"])


@query("""SELECT row_id, days, record_id FROM (SELECT s.row_id, date_diff('day', CAST(u.recorded_at AS DATE), CAST(s.sale_date AS DATE))::INT * -1 AS days, u.record_id, u.bldg_quality_num AS q FROM sales s JOIN universe u ON u.key = s.key WHERE NOT coalesce(isnan(u.bldg_quality_num), false)) WHERE days < 0
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY q DESC NULLS LAST, days DESC, record_id DESC) = 1""")
def asof_backward(spark, d):
    s = table(spark, d, "sales").select("key", "row_id", "sale_date")
    u = table(spark, d, "universe").where("not coalesce(isnan(bldg_quality_num), false)")
    return asof.best_before(s, u, "key", "row_id", "sale_date", "recorded_at", F.col("bldg_quality_num"), ["record_id"])


def _refine(n: int, v: str) -> str:
    return f"""e{n} AS (SELECT c, quantile_cont({v}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM l{n} GROUP BY 1), b{n} AS (SELECT l{n}.*, CASE WHEN {v} IS NOT NULL THEN greatest(1, len(list_filter(list_distinct(e), lambda x: x < {v}))) END AS b FROM l{n} LEFT JOIN e{n} USING (c)),
f{n} AS (SELECT c, sum(n) >= 5 AND min(n) FILTER (b IS NOT NULL) >= 5 AND count(b) > 1 AS fit FROM (SELECT c, b, count(*) AS n FROM b{n} GROUP BY 1, 2) GROUP BY 1),
l{n + 1} AS (SELECT record_id, land, area, CASE WHEN fit THEN c || '_' || coalesce(b::VARCHAR, '0') ELSE c END AS c FROM b{n} JOIN f{n} USING (c))"""


@query(f"WITH l0 AS (SELECT record_id, land_area_sqft::DOUBLE AS land, bldg_area_finished_sqft::DOUBLE AS area, coalesce(neighborhood, '') || '_' || coalesce(model_group, '') AS c FROM universe), {_refine(0, 'land')}, {_refine(1, 'area')} SELECT record_id, c AS cluster FROM l2")
def cluster_refine(spark, d):
    u = table(spark, d, "universe").select("record_id", "neighborhood", "model_group", F.col("land_area_sqft").cast("double").alias("land"), F.col("bldg_area_finished_sqft").cast("double").alias("area"))
    return bins.refine_clusters(u, ["neighborhood", "model_group"], ["land", "area"], 5, "cluster").select("record_id", "cluster")


@query("""SELECT c_custkey, round(c_acctbal * sqrt(2 / 3) - (lag(c_acctbal) OVER w + lag(c_acctbal, 2) OVER w) * sqrt(2 / 3) / 2, 6) AS diff FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def differenced(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    got = series.differences(c, ["c_nationkey"], ["c_custkey"], "c_acctbal", series.difference_weights(2), "diff")
    return got.select("c_custkey", F.round("diff", 6).alias("diff"))
