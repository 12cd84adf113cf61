"""Queries of joins, set operations, de-duplication and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import dedupe, frames, groups
from plumbline.plans.registry import Family
from plumbline.plans.tables import table

family = Family()
query = family.query


@query("""SELECT c.c_custkey, c.c_name, coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_nationkey END, o.nk, 99::INT) AS c_nationkey, o.n_orders
FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey % 25)::INT AS nk, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def merge_reconcile(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"), F.count(F.lit(1)).alias("n_orders"))
    fallback = table(spark, d, "customer").select("c_custkey", F.lit(99).alias("c_nationkey"))
    steps = [{"id": "base"}, {"id": "orders", "left_on": "c_custkey", "right_on": "o_custkey"}, {"id": "fallback", "on": "c_custkey"}]
    return frames.merge([("base", c), ("orders", o), ("fallback", fallback)], steps, key="c_custkey")


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def merge_append(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return frames.merge([("s", s), ("c", c)], [{"id": "s"}, {"id": "c", "how": "append"}])


_TWO = """WITH l AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, p_size FROM part),
r AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS brand, p_retailprice FROM part WHERE p_partkey % 5 > 0) """


def _two(spark, d):
    p = table(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"), "p_size")
    right = p.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("brand"), "p_retailprice")
    return left, right


@query(_TWO + "SELECT l.key, coalesce(l.brand, r.brand) AS brand, p_size, p_retailprice FROM l LEFT JOIN r USING (key)")
def stomp_left(spark, d):
    return frames.stomp(*_two(spark, d), "key")


@query(_TWO + "SELECT l.key, coalesce(r.brand, l.brand) AS brand, p_size, p_retailprice FROM l LEFT JOIN r USING (key)")
def stomp_right(spark, d):
    return frames.stomp(*_two(spark, d), "key", right_wins=True)


@query(_TWO + "SELECT l.key, CASE WHEN r.key IS NOT NULL THEN r.brand ELSE l.brand END AS brand, p_size, p_retailprice FROM l LEFT JOIN r ON l.key = r.key")
def update_overwrite(spark, d):
    return frames.keyed_update(*_two(spark, d), "key", overwrite=True)


@query(_TWO + "SELECT l.key, coalesce(l.brand, r.brand) AS brand, p_size, p_retailprice FROM l LEFT JOIN r ON l.key = r.key")
def update_fill(spark, d):
    return frames.keyed_update(*_two(spark, d), "key")


@query("SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_ref(spark, d):
    return frames.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT s.row_id, s.key, coalesce(s.model_group, u.model_group) AS model_group, u.neighborhood FROM sales s LEFT JOIN (SELECT key, model_group, neighborhood FROM universe QUALIFY row_number() OVER (PARTITION BY key ORDER BY record_id) = 1) u ON u.key = s.key")
def hydrate_sales(spark, d):
    u = dedupe.keep_first(table(spark, d, "universe").where("key is not null"), ["key"], ["record_id"]).select("key", "model_group", "neighborhood")
    pair = frames.ParcelSales(u, table(spark, d, "sales").select("row_id", "key", "model_group"))
    return pair.hydrated()


@query("SELECT row_id FROM sales WHERE key IN (SELECT key FROM universe WHERE is_vacant AND key IS NOT NULL)")
def semi_keys(spark, d):
    return frames.having(table(spark, d, "sales").select("row_id", "key"), table(spark, d, "universe").where("is_vacant"), "key").select("row_id")


@query("SELECT row_id FROM sales s WHERE NOT EXISTS (SELECT 1 FROM universe u WHERE u.key = s.key)")
def anti_keys(spark, d):
    return frames.lacking(table(spark, d, "sales").select("row_id", "key"), table(spark, d, "universe"), "key").select("row_id")


@query("SELECT feed FROM sales UNION SELECT feed FROM universe")
def union_distinct(spark, d):
    return table(spark, d, "sales").select("feed").union(table(spark, d, "universe").select("feed")).distinct()


@query("SELECT key FROM sales INTERSECT SELECT key FROM universe")
def intersect_keys(spark, d):
    return table(spark, d, "sales").select("key").intersect(table(spark, d, "universe").select("key"))


@query("SELECT key FROM universe EXCEPT SELECT key FROM sales")
def except_keys(spark, d):
    return table(spark, d, "universe").select("key").subtract(table(spark, d, "sales").select("key"))


@query("""SELECT (SELECT count(DISTINCT key) FROM sales) AS distinct_a, (SELECT count(DISTINCT key) FROM universe) AS distinct_b,
(SELECT count(*) FROM (SELECT key FROM sales WHERE key IS NOT NULL INTERSECT SELECT key FROM universe)) AS in_both""")
def match_counts(spark, d):
    return frames.match_counts(table(spark, d, "sales"), table(spark, d, "universe"), "key", "key")


@query("""SELECT coalesce(a.feed, b.feed) AS feed, n_sales, n_parcels FROM (SELECT feed, count(*) AS n_sales FROM sales WHERE feed IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT feed, count(*) AS n_parcels FROM universe WHERE feed IS NOT NULL GROUP BY 1) b ON a.feed = b.feed""")
def full_outer_stats(spark, d):
    count = lambda t, n: table(spark, d, t).where("feed is not null").groupBy("feed").agg(F.count(F.lit(1)).alias(n))
    return count("sales", "n_sales").join(count("universe", "n_parcels"), "feed", "full")


@query("""WITH f AS (SELECT substr(key, 1, 10) AS parent, key, land_area_sqft FROM universe WHERE land_area_sqft IS NOT NULL AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY substr(key, 1, 10) ORDER BY land_area_sqft DESC, record_id) = 1)
SELECT u.record_id, f.key AS parent_key, coalesce(u.land_area_sqft, f.land_area_sqft) AS land_area_sqft FROM universe u LEFT JOIN f ON f.parent = substr(u.key, 1, 10)""")
def prefix_link(spark, d):
    u = table(spark, d, "universe").select("record_id", "key", "land_area_sqft").withColumn("parent", F.substring("key", 1, 10))
    top = dedupe.keep_first(u.where("land_area_sqft is not null and key is not null"), ["parent"], [["land_area_sqft", "desc"], "record_id"]).select("parent", F.col("key").alias("parent_key"), "land_area_sqft")
    return frames.stomp(u.drop("key"), top, "parent").drop("parent")


@query("SELECT * EXCLUDE (rn) FROM (SELECT key, record_id, feed, recorded_at, row_number() OVER (PARTITION BY key ORDER BY recorded_at DESC NULLS LAST, record_id) AS rn FROM universe) WHERE rn = 1")
def dedupe_first(spark, d):
    return dedupe.keep_first(table(spark, d, "universe").select("key", "record_id", "feed", "recorded_at"), ["key"], [["recorded_at", "desc"], "record_id"])


@query("SELECT record_id, key FROM universe QUALIFY count(*) OVER (PARTITION BY key) = 1")
def dedupe_all(spark, d):
    return dedupe.drop_repeated(table(spark, d, "universe").select("record_id", "key"), ["key"])


@query("""WITH s AS (SELECT row_id, key_sale, deed_book, CASE WHEN NOT isnan(sale_price) THEN sale_price END AS sale_price, recorded_at FROM sales),
f AS (SELECT key_sale, row_id, recorded_at FROM s QUALIFY row_number() OVER (PARTITION BY key_sale ORDER BY recorded_at NULLS LAST, row_id) = 1),
a AS (SELECT key_sale, max(sale_price) AS top_price, round(avg(sale_price), 6) AS mean_price, median(sale_price) AS mid_price, count(sale_price) AS n_prices, count(DISTINCT sale_price) AS n_distinct,
list(deed_book ORDER BY recorded_at NULLS LAST, row_id) FILTER (deed_book IS NOT NULL)[1] AS deed_book, list(deed_book ORDER BY recorded_at NULLS LAST, row_id) FILTER (deed_book IS NOT NULL)[-1] AS last_book FROM s GROUP BY 1)
SELECT f.*, a.* EXCLUDE (key_sale) FROM f JOIN a ON f.key_sale IS NOT DISTINCT FROM a.key_sale""")
def dedupe_agg(spark, d):
    s = table(spark, d, "sales").select("row_id", "key_sale", "deed_book", F.when(~F.isnan("sale_price"), F.col("sale_price")).alias("sale_price"), "recorded_at")
    by = ["recorded_at", "row_id"]
    agg = {
        "top_price": {"field": "sale_price", "op": "max"}, "mean_price": {"field": "sale_price", "op": "mean"}, "mid_price": {"field": "sale_price", "op": "median"}, "n_prices": {"field": "sale_price", "op": "count"},
        "n_distinct": {"field": "sale_price", "op": "nunique"}, "deed_book": {"field": "deed_book", "op": "first", "sort_by": by}, "last_book": {"field": "deed_book", "op": "last", "sort_by": by},
    }
    return dedupe.collapse(s, ["key_sale"], by, agg).drop("sale_price").withColumn("mean_price", F.round("mean_price", 6))


_U = "CASE WHEN NOT isnan(total_value) THEN total_value END"


@query(f"""SELECT neighborhood, round(avg(v), 4) AS v_mean, median(v) AS v_median, round(stddev_samp(v), 4) AS v_std, min(v) AS v_min, max(v) AS v_max, round(sum(v), 2) AS v_sum, count(v) AS v_count,
round(CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / avg(v) END, 8) AS v_cv, round(quantile_cont(v, 0.25), 6) AS v_p25, round(quantile_cont(v, 0.75), 6) AS v_p75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS v_iqr
FROM (SELECT neighborhood, {_U} AS v FROM universe) GROUP BY 1""")
def area_numeric(spark, d):
    got = groups.numeric_stats(table(spark, d, "universe"), ["neighborhood"], "total_value", "v")
    return got.withColumns({**{f"v_{s}": F.round(f"v_{s}", 4) for s in ("mean", "std")}, "v_sum": F.round("v_sum", 2), "v_cv": F.round("v_cv", 8), **{f"v_{s}": F.round(f"v_{s}", 6) for s in ("p25", "p75", "iqr")}})


@query("""WITH n AS (SELECT neighborhood, bldg_type AS v, count(*) AS n FROM universe WHERE bldg_type IS NOT NULL GROUP BY 1, 2)
SELECT neighborhood, list(v ORDER BY n DESC, v)[1] AS t_mode, max(n) / sum(n) AS t_mode_frac, count(*) AS t_nunique, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS t_entropy FROM n GROUP BY 1""")
def area_categorical(spark, d):
    return groups.category_stats(table(spark, d, "universe"), ["neighborhood"], "bldg_type", "t").withColumn("t_entropy", F.round("t_entropy", 8))


@query(f"""WITH g AS (SELECT census_block_group, count({_U}) AS v_count, round(avg({_U}), 4) AS v_mean, median({_U}) AS v_median FROM universe GROUP BY 1)
SELECT census_block_group, v_count, CASE WHEN v_count >= 5 THEN v_mean END AS v_mean, CASE WHEN v_count >= 5 THEN v_median END AS v_median FROM g""")
def area_mincount(spark, d):
    got = groups.numeric_stats(table(spark, d, "universe"), ["census_block_group"], "total_value", "v").select("census_block_group", "v_count", F.round("v_mean", 4).alias("v_mean"), "v_median")
    return groups.masked(got, "v_count", ["v_mean", "v_median"], 5)


@query("""SELECT u.neighborhood, count(*) AS sales_count, count(*) FILTER (s.vacant_sale) AS sales_count_vacant, count(*) FILTER (NOT coalesce(s.vacant_sale, false)) AS sales_count_improved FROM sales s
JOIN (SELECT key, neighborhood FROM universe WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY record_id) = 1) u ON u.key = s.key WHERE s.valid_sale GROUP BY 1""")
def area_sale_counts(spark, d):
    u = dedupe.keep_first(table(spark, d, "universe").where("key is not null"), ["key"], ["record_id"]).select("key", "neighborhood")
    s = table(spark, d, "sales").where("valid_sale").select("key", "vacant_sale").join(u, "key")
    return s.groupBy("neighborhood").agg(F.count(F.lit(1)).alias("sales_count"), F.count_if("vacant_sale").alias("sales_count_vacant"), F.count_if(~F.coalesce("vacant_sale", F.lit(False))).alias("sales_count_improved"))


@query("""SELECT record_id, CASE WHEN is_vacant AND land_area_sqft <> 0 THEN land_value / land_area_sqft END AS value_vacant_land_sqft, CASE WHEN NOT is_vacant AND bldg_area_finished_sqft <> 0 THEN total_value / bldg_area_finished_sqft END AS value_impr_sqft,
CASE WHEN land_area_sqft <> 0 THEN total_value / land_area_sqft END AS value_land_sqft FROM universe""")
def unit_rates(spark, d):
    u = table(spark, d, "universe")
    return u.select(
        "record_id", F.when(F.col("is_vacant"), F.try_divide("land_value", F.col("land_area_sqft"))).alias("value_vacant_land_sqft"),
        F.when(~F.col("is_vacant"), F.try_divide("total_value", F.col("bldg_area_finished_sqft"))).alias("value_impr_sqft"), F.try_divide("total_value", F.col("land_area_sqft")).alias("value_land_sqft"),
    )


@query("""WITH u AS (SELECT census_block_group AS g, count(*) AS n FROM universe WHERE census_block_group IS NOT NULL GROUP BY 1), s AS (SELECT u.census_block_group AS g, count(*) AS n FROM sales s JOIN universe u ON u.key = s.key WHERE u.census_block_group IS NOT NULL GROUP BY 1),
r AS (SELECT g FROM u FULL JOIN s USING (g) WHERE coalesce(u.n, 0) < 10 OR coalesce(s.n, 0) < 30), k AS (SELECT count(*) AS k FROM r)
SELECT record_id, CASE WHEN k >= 2 AND r.g IS NOT NULL THEN 'OTHER' ELSE census_block_group END AS census_block_group FROM universe CROSS JOIN k LEFT JOIN r ON r.g = census_block_group""")
def sparse_collapse(spark, d):
    u = table(spark, d, "universe").select("record_id", "key", "census_block_group")
    s = table(spark, d, "sales").select("row_id", "key").join(u, "key").select("row_id", "census_block_group")
    return groups.collapse_sparse(u.drop("key"), s, "census_block_group", 10, 30)[0]


@query("""SELECT record_id, coalesce(bldg_age_years, median(bldg_age_years) OVER (PARTITION BY model_group)) AS bldg_age_years FROM (SELECT record_id, model_group, CASE WHEN NOT isnan(bldg_age_years) THEN bldg_age_years END AS bldg_age_years FROM universe)""")
def fill_median_group(spark, d):
    u = table(spark, d, "universe").select("record_id", "model_group", F.when(~F.isnan("bldg_age_years"), F.col("bldg_age_years")).alias("bldg_age_years"))
    return groups.fill_by_group(u, ["model_group"], "bldg_age_years", "median").drop("model_group")


@query("""WITH n AS (SELECT model_group, bldg_type, count(*) AS n FROM universe WHERE bldg_type IS NOT NULL AND NOT is_vacant GROUP BY 1, 2), m AS (SELECT model_group, list(bldg_type ORDER BY n DESC, bldg_type)[1] AS t FROM n GROUP BY 1)
SELECT record_id, CASE WHEN bldg_type IS NULL AND coalesce(NOT is_vacant, false) THEN t ELSE bldg_type END AS bldg_type FROM universe u LEFT JOIN m ON u.model_group IS NOT DISTINCT FROM m.model_group""")
def fill_mode_group(spark, d):
    u = table(spark, d, "universe").select("record_id", "model_group", "bldg_type", "is_vacant")
    return groups.fill_by_group(u, ["model_group"], "bldg_type", "mode", ~F.col("is_vacant")).select("record_id", "bldg_type")


@query("""SELECT row_id, n_deed > 1 AS same_deed, n_price > 1 AS same_price_day FROM (SELECT row_id, CASE WHEN deed_book IS NOT NULL AND deed_page IS NOT NULL AND sale_date IS NOT NULL THEN count(*) OVER (PARTITION BY deed_book, deed_page, sale_date) ELSE 1 END AS n_deed,
CASE WHEN sale_price IS NOT NULL AND sale_date IS NOT NULL THEN count(*) OVER (PARTITION BY sale_date, sale_price) ELSE 1 END AS n_price FROM sales)""")
def dupe_heuristic(spark, d):
    s = table(spark, d, "sales").select("row_id", "deed_book", "deed_page", "sale_date", "sale_price")
    s = groups.repeated(s, ["deed_book", "deed_page", "sale_date"], "same_deed")
    return groups.repeated(s, ["sale_date", "sale_price"], "same_price_day").select("row_id", "same_deed", "same_price_day")


_PROFILED = {"total_value": "number", "is_vacant": "boolean", "city": "text", "recorded_at": "date", "land_area_sqft": "number"}


def _profile_sql() -> str:
    value = {"total_value": "CASE WHEN NOT isnan(total_value) THEN total_value END"}
    zero = {"number": "<> 0", "boolean": "", "text": "<> ''", "date": "IS NOT NULL"}
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{k}' AS kind, count(*) AS n, count(v) AS non_null, count(*) FILTER (v {zero[k]}) AS non_zero, count(DISTINCT v) AS distinct_values FROM (SELECT {value.get(f, f)} AS v FROM universe)" for f, k in _PROFILED.items()
    )


@query(_profile_sql())
def profile_columns(spark, d):
    return groups.profile(table(spark, d, "universe").select(*_PROFILED))


_REP = ["total_value", "land_area_sqft", "bldg_area_finished_sqft"]


def _representation_sql() -> str:
    side = lambda t, n, f: f"SELECT round(avg(coalesce((v <> 0)::INT, 0)), 8) AS {n}_non_zero, round(avg(v), 4) AS {n}_mean, median(v) AS {n}_median FROM (SELECT CASE WHEN NOT isnan({f}::DOUBLE) THEN {f}::DOUBLE END AS v FROM {t})"
    rows = [f"SELECT '{f}' AS field, * FROM ({side('s', 'sales', f)}), ({side('universe', 'universe', f)})" for f in _REP]
    return "WITH s AS (SELECT u.* FROM sales x JOIN (SELECT * FROM universe WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY record_id) = 1) u ON u.key = x.key) " + " UNION ALL ".join(rows)


@query(_representation_sql())
def representation(spark, d):
    u = table(spark, d, "universe").select("record_id", "key", *_REP)
    s = table(spark, d, "sales").select("key").join(dedupe.keep_first(u.where("key is not null"), ["key"], ["record_id"]), "key")
    got = groups.representation(s, u, _REP)
    return got.withColumns({f"{t}_{k}": F.round(f"{t}_{k}", n) for t in ("sales", "universe") for k, n in (("non_zero", 8), ("mean", 4))})


@query("""WITH v AS (SELECT model_group, sale_price AS p FROM sales WHERE sale_price > 0 AND NOT isnan(sale_price)), m AS (SELECT model_group, median(p) AS median FROM v GROUP BY 1)
SELECT v.model_group, count(*) AS n, m.median, round(100 * avg(abs(p - m.median)) / m.median, 6) AS cod FROM v JOIN m ON m.model_group = v.model_group GROUP BY v.model_group, m.median""")
def cod_by_group(spark, d):
    s = table(spark, d, "sales").where("sale_price > 0 and not isnan(sale_price) and model_group is not null")
    return groups.deviation(s, ["model_group"], "sale_price").withColumn("cod", F.round("cod", 6))
