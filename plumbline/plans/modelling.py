"""Queries of predictions, ensembles, splits, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import predict, split
from plumbline.plans.registry import Family
from plumbline.plans.statistics import _J, _joined
from plumbline.plans.tables import table

family = Family()
query = family.query

_TRAIN = "l_orderkey % 5 > 0"


def _two(spark, d):
    j = _joined(spark, d).select("l_orderkey", "p_brand", "p_type", "p_size", "pred", "truth", "l_quantity", "l_discount", "l_tax")
    return j.where(_TRAIN), j.where(f"not ({_TRAIN})")


_SPLIT = f"{_J}, tr AS (SELECT * FROM j WHERE {_TRAIN}), te AS (SELECT * FROM j WHERE NOT ({_TRAIN}))"


@query(f"WITH {_SPLIT} SELECT l_orderkey, truth, (SELECT median(truth) FROM tr) AS prediction, round((SELECT avg(truth) FROM tr), 6) AS mean_prediction FROM te")
def mean_median_model(spark, d):
    tr, te = _two(spark, d)
    got = predict.constant(tr, te.select("l_orderkey", "truth"), "truth")
    return predict.constant(tr, got, "truth", "mean", "mean_prediction").withColumn("mean_prediction", F.round("mean_prediction", 6))


@query(f"WITH {_SPLIT} SELECT l_orderkey, truth, l_quantity * (SELECT median(truth / l_quantity) FROM tr WHERE l_quantity > 0) AS prediction FROM te")
def naive_area_model(spark, d):
    tr, te = _two(spark, d)
    return predict.local_area(tr, te.select("l_orderkey", "truth", "l_quantity"), "truth", "l_quantity", []).drop("l_quantity")


@query(f"""WITH {_SPLIT}, a AS (SELECT p_brand, median(truth / l_quantity) AS r FROM tr WHERE l_quantity > 0 AND p_brand IS NOT NULL GROUP BY 1), b AS (SELECT p_type, median(truth / l_quantity) AS r FROM tr WHERE l_quantity > 0 GROUP BY 1)
SELECT l_orderkey, truth, l_quantity * coalesce(nullif(a.r, 0), nullif(b.r, 0), (SELECT median(truth / l_quantity) FROM tr WHERE l_quantity > 0)) AS prediction FROM te LEFT JOIN a USING (p_brand) LEFT JOIN b USING (p_type)""")
def local_area_model(spark, d):
    tr, te = _two(spark, d)
    return predict.local_area(tr, te, "truth", "l_quantity", ["p_brand", "p_type"]).select("l_orderkey", "truth", "prediction")


@query("SELECT record_id, total_value AS prediction FROM universe")
def pass_through_model(spark, d):
    return table(spark, d, "universe").select("record_id", F.col("total_value").alias("prediction"))


@query(f"WITH {_SPLIT}, f AS (SELECT regr_slope(truth, l_quantity) AS b, regr_intercept(truth, l_quantity) AS a FROM tr) SELECT l_orderkey, truth, round(a + b * l_quantity, 4) AS prediction FROM te, f")
def ols_univariate_predict(spark, d):
    tr, te = _two(spark, d)
    got = predict.apply_linear(te, predict.linear(tr, ["l_quantity"], "truth"), ["l_quantity"])
    return got.select("l_orderkey", "truth", F.round("prediction", 4).alias("prediction"))


@query(f"""WITH {_SPLIT}, f AS (SELECT p_brand, regr_slope(truth, l_quantity) AS b, regr_intercept(truth, l_quantity) AS a FROM tr GROUP BY 1 HAVING count(*) >= 2) SELECT l_orderkey, truth, round(a + b * l_quantity, 4) AS prediction FROM te JOIN f USING (p_brand)""")
def per_location_ols(spark, d):
    tr, te = _two(spark, d)
    got = predict.per_location_linear(tr, te, ["l_quantity"], "truth", "p_brand")
    return got.select("l_orderkey", "truth", F.round("prediction", 4).alias("prediction"))


@query()
def mra_model(spark, d):
    """Several variables; the closed form is tested against numpy."""
    tr, te = _two(spark, d)
    xs = ["l_quantity", "l_discount", "l_tax", "p_size"]
    return predict.apply_linear(te, predict.linear(tr, xs, "truth"), xs).select("l_orderkey", "truth", F.round("prediction", 4).alias("prediction"))


@query("SELECT p_partkey, " + ", ".join(f"(p_type = '{v}')::INT AS \"t_{v}\"" for v in ("ECONOMY", "LARGE")) + " FROM part")
def onehot(spark, d):
    return predict.one_hot(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["AAA", "ECONOMY", "LARGE"], "t").drop("p_type")


@query("SELECT record_id, greatest(0, least(land_value, total_value)) AS land FROM universe WHERE land_value IS NOT NULL AND total_value IS NOT NULL")
def clamp_land(spark, d):
    u = table(spark, d, "universe").where("land_value is not null and total_value is not null")
    return u.select("record_id", F.greatest(F.lit(0.0), F.least("land_value", "total_value")).alias("land"))


_MEMBERS = "m AS (SELECT row_number() OVER () AS x, l_orderkey, p_brand, truth, pred AS m1, CASE WHEN l_orderkey % 7 > 0 THEN truth * 1.1 END AS m2, l_quantity * 1500.0 AS m3 FROM j)"


def _members(spark, d):
    return _joined(spark, d).select("l_orderkey", "p_brand", "truth", F.col("pred").alias("m1"), F.when(F.col("l_orderkey") % 7 > 0, F.col("truth") * 1.1).alias("m2"), (F.col("l_quantity") * 1500.0).alias("m3"))


@query(f"WITH {_J}, {_MEMBERS} SELECT l_orderkey, list_median, round(list_mean, 6) AS list_mean FROM (SELECT l_orderkey, list_aggregate(list_filter([m1, m2, m3], lambda v: v IS NOT NULL), 'median') AS list_median, list_aggregate(list_filter([m1, m2, m3], lambda v: v IS NOT NULL), 'avg') AS list_mean FROM m)")
def ensemble_mean_median(spark, d):
    m = [F.col(c) for c in ("m1", "m2", "m3")]
    return _members(spark, d).select("l_orderkey", predict.row_median(m).alias("list_median"), F.round(predict.row_mean(m), 6).alias("list_mean"))


@query(f"""WITH {_J}, {_MEMBERS}, l AS (SELECT p_brand, truth, unnest(['m1', 'm2', 'm3']) AS member, unnest([m1, m2, m3]) AS p FROM m WHERE truth > 0), e AS (SELECT p_brand, member, avg(abs(p - truth) / truth) AS mape FROM l WHERE p IS NOT NULL GROUP BY 1, 2),
b AS (SELECT p_brand, member FROM e QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY mape, member) = 1)
SELECT l_orderkey, truth, coalesce(CASE member WHEN 'm1' THEN m1 WHEN 'm2' THEN m2 WHEN 'm3' THEN m3 END, m1) AS prediction FROM m LEFT JOIN b USING (p_brand)""")
def ensemble_local(spark, d):
    m = _members(spark, d)
    best = predict.best_by_location(m, "truth", ["m1", "m2", "m3"], "p_brand")
    return predict.paint(m, best, ["m1", "m2", "m3"], "p_brand", F.col("m1")).select("l_orderkey", "truth", "prediction")


@query(f"""WITH {_J}, {_MEMBERS}, r AS (SELECT x, l_orderkey, unnest([1, 2, 3]) AS i, unnest([m1, m2, m3]) AS v FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY v, i) AS k, count(*) OVER (PARTITION BY x) AS n FROM r WHERE v IS NOT NULL),
w AS (SELECT l_orderkey, x, i, ((k = (n + 1) // 2)::INT + (k = n // 2 + 1)::INT) / 2.0 AS w FROM o)
SELECT l_orderkey, coalesce(sum(w) FILTER (i = 1), 0)::DOUBLE AS weight_m1, coalesce(sum(w) FILTER (i = 2), 0)::DOUBLE AS weight_m2, coalesce(sum(w) FILTER (i = 3), 0)::DOUBLE AS weight_m3 FROM w GROUP BY l_orderkey, x""")
def median_weights(spark, d):
    return _members(spark, d).select("l_orderkey", *predict.median_weights(["m1", "m2", "m3"]))


@query()
def ensemble_backward(spark, d):
    kept = predict.backward_ensemble(_members(spark, d), "truth", ["m1", "m2", "m3"])
    return spark.createDataFrame(list(enumerate(kept)), "place int, member string")


@query(f"WITH {_SPLIT}, f AS (SELECT regr_slope(truth, l_quantity) AS b, regr_intercept(truth, l_quantity) AS a FROM tr) SELECT l_orderkey, round(a, 4) AS base, round(b * l_quantity, 4) AS contribution_l_quantity, round(a + b * l_quantity, 4) AS prediction FROM te, f")
def linear_contributions(spark, d):
    tr, te = _two(spark, d)
    got = predict.contributions(te, predict.linear(tr, ["l_quantity"], "truth"), "l_orderkey", ["l_quantity"])
    return got.withColumns({c: F.round(c, 4) for c in got.columns if c != "l_orderkey"})


@query("""WITH u AS (SELECT record_id, neighborhood, city, land_area_sqft::DOUBLE AS land, CASE WHEN bldg_area_finished_sqft % 3 > 0 THEN bldg_area_finished_sqft::DOUBLE END AS area FROM universe),
r0 AS (SELECT *, area / land AS r FROM u WHERE area > 0 AND land > 0), q AS (SELECT quantile_cont(r, 0.01) AS a, quantile_cont(r, 0.99) AS z FROM r0), r AS (SELECT r0.* FROM r0, q WHERE r BETWEEN a AND z),
n AS (SELECT neighborhood, median(r) AS m FROM r WHERE neighborhood IS NOT NULL GROUP BY 1), c AS (SELECT city, median(r) AS m FROM r WHERE city IS NOT NULL GROUP BY 1)
SELECT record_id, CASE WHEN area IS NULL AND land IS NOT NULL THEN round_even(land * coalesce(n.m, c.m, (SELECT median(r) FROM r)), 0) ELSE area END AS area, area IS NULL AND land IS NOT NULL AS inferred_area FROM u LEFT JOIN n USING (neighborhood) LEFT JOIN c USING (city)""")
def ratio_proxy_infer(spark, d):
    u = table(spark, d, "universe").select("record_id", "neighborhood", "city", F.col("land_area_sqft").cast("double").alias("land"), F.when(F.col("bldg_area_finished_sqft") % 3 > 0, F.col("bldg_area_finished_sqft").cast("double")).alias("area"))
    return predict.ratio_proxy(u, "area", "land", ["neighborhood", "city"], "area").select("record_id", "area", "inferred_area")


@query("SELECT model_group, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM sales GROUP BY 1")
def split_sizes(spark, d):
    s = split.stratified(table(spark, d, "sales").select("row_id", "model_group"), "row_id", ["model_group"], 0.2)
    return s.groupBy("model_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("n_test"))


@query("""WITH s AS (SELECT row_id, sale_year, date_diff('day', CAST(sale_date AS DATE), DATE '2024-01-01') AS age FROM sales), g AS (SELECT sale_year % 3 AS g, count(*) AS n, count(*) FILTER (age < 0) AS n0, count(*) FILTER (age BETWEEN 0 AND 365) AS n1 FROM s GROUP BY 1)
SELECT g, n, n0 + greatest(0, round(n * 0.3) - n0)::BIGINT AS n_test, n0 AS after_date, least(greatest(0, round(n * 0.3) - n0), floor(n1 * 0.5))::BIGINT AS look_back FROM g""")
def three_tier_split(spark, d):
    s = table(spark, d, "sales").select("row_id", (F.col("sale_year") % 3).alias("g"), F.datediff(F.lit("2024-01-01").cast("date"), "sale_date").alias("age"))
    t = split.three_tier(s, "row_id", ["g"], "age", 365, 0.3)
    test = F.col("split") == "test"
    return t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("n_test"), F.count_if(test & (F.col("age") < 0)).alias("after_date"), F.count_if(test & F.col("age").between(0, 365)).alias("look_back"))


@query()
def hash_split(spark, d):
    return split.hash_split(table(spark, d, "sales").select("row_id", "key"), "key", 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT record_id, CASE WHEN is_vacant THEN 'vacant' WHEN coalesce(bldg_area_finished_sqft, 0) >= 5000 THEN 'large' WHEN coalesce(bldg_type IN ('A', 'B'), false) THEN 'ab' ELSE 'UNKNOWN' END AS model_group FROM universe""")
def model_group_tag(spark, d):
    from plumbline.plans.settings import tag_first

    rules = {"vacant": ["==", "is_vacant", True], "large": [">=", "bldg_area_finished_sqft", 5000], "ab": ["isin", "bldg_type", ["str:A", "str:B"]]}
    return tag_first(table(spark, d, "universe").drop("model_group"), rules, "model_group").select("record_id", "model_group")


@query("""SELECT record_id, coalesce(bldg_area_finished_sqft, 0) = 0 AS vacant, CASE WHEN coalesce(bldg_area_finished_sqft, 0) = 0 THEN 'UNKNOWN' ELSE bldg_type END AS bldg_type, CASE WHEN coalesce(bldg_area_finished_sqft, 0) = 0 THEN 0.0 ELSE bldg_quality_num END AS bldg_quality_num FROM universe""")
def vacancy_reset(spark, d):
    u = table(spark, d, "universe").select("record_id", "bldg_area_finished_sqft", "bldg_type", "bldg_quality_num").withColumn("vacant", F.coalesce("bldg_area_finished_sqft", F.lit(0)) == 0)
    return u.withColumns({"bldg_type": F.when(F.col("vacant"), "UNKNOWN").otherwise(F.col("bldg_type")), "bldg_quality_num": F.when(F.col("vacant"), 0.0).otherwise(F.col("bldg_quality_num"))}).drop("bldg_area_finished_sqft")


@query()
def boosted_model(spark, d):
    tr, te = _two(spark, d)
    xs = ["l_quantity", "l_discount", "l_tax", "p_size"]
    return predict.boosted(tr, te, xs, "truth", rounds=3, depth=3).select("l_orderkey", "truth", "prediction")


@query()
def variable_drop(spark, d):
    xs = ["land_area_sqft", "bldg_area_finished_sqft", "bldg_age_years", "bldg_quality_num", "bldg_condition_num"]
    u = table(spark, d, "universe").select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in [*xs, "total_value"]])
    kept = predict.recursive_drop(u, xs, "total_value")
    return spark.createDataFrame(list(enumerate(kept)), "place int, variable string")


@query()
def forest_model(spark, d):
    tr, te = _two(spark, d)
    return predict.forest(tr, te, ["l_quantity", "l_discount", "l_tax", "p_size"], "truth", trees=5, depth=3).select("l_orderkey", "truth", "prediction")


@query("""WITH m AS (SELECT model_group, sale_year::DOUBLE AS y, median(sale_price) AS p FROM sales WHERE sale_price > 0 AND NOT isnan(sale_price) AND sale_year BETWEEN 2005 AND 2026 AND model_group IS NOT NULL GROUP BY 1, 2)
SELECT model_group, round(regr_slope(p, y), 4) AS slope, round(regr_intercept(p, y) + regr_slope(p, y) * (max(y) + 2), 2) AS projected FROM m GROUP BY 1""")
def projected_trend(spark, d):
    s = table(spark, d, "sales").where("sale_price > 0 and not isnan(sale_price) and sale_year between 2005 and 2026 and model_group is not null")
    m = s.groupBy("model_group", F.col("sale_year").cast("double").alias("y")).agg(F.median("sale_price").alias("p"))
    return predict.trend(m, ["model_group"], "y", "p", 2).select("model_group", F.round("slope", 4).alias("slope"), F.round("projected", 2).alias("projected"))


_METRICS = ["n", "mse", "mape"]


@query(f"WITH {_J}, {_MEMBERS}, l AS (SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest([m1, m2, m3]) AS p, truth FROM m) SELECT model, count(*) AS n, round(avg((p - truth) ** 2), 2) AS mse, round(avg(abs(p - truth) / truth), 8) AS mape FROM l WHERE p IS NOT NULL AND truth > 0 GROUP BY 1")
def benchmark_table(spark, d):
    """Metrics by model: the members' long form in one pass."""
    from plumbline.operators import ratios

    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("m1", "m2", "m3")])).alias("x")
    got = ratios.fit_metrics(_members(spark, d).select("truth", long).select("truth", "x.*"), ["model"], "p", "truth")
    return got.select("model", "n", F.round("mse", 2).alias("mse"), F.round("mape", 8).alias("mape"))


@query()
def elastic_net(spark, d):
    return predict.elastic_net(_joined(spark, d), ["l_quantity", "l_discount", "l_tax", "p_size"], "truth", 100.0)


@query()
def cross_validation(spark, d):
    j = _joined(spark, d).withColumn("k", F.xxhash64("l_orderkey", "truth", "pred"))
    return predict.cross_validated(j, "k", ["l_quantity", "p_size"], "truth")


@query()
def random_model(spark, d):
    tr, te = _two(spark, d)
    got = predict.random_baseline(tr, te.select("l_orderkey", "truth"), "l_orderkey", "truth")
    return got.withColumn("chased", predict.chased(F.col("prediction"), F.col("truth"), F.col("l_orderkey")))
