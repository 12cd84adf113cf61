"""Queries of ratio and equity statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import bins, ratios
from plumbline.plans.registry import Family
from plumbline.plans.tables import table
from plumbline.session import cut, kept

family = Family()
query = family.query

#: Assessment ratios on the order tables: the retail price times quantity against the extended price.
_J = "j AS (SELECT p_brand, p_type, p_size, p_retailprice * l_quantity AS pred, l_extendedprice AS truth, l_quantity, l_discount, l_tax, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _joined(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice")
    return line.join(part, "l_partkey").withColumns({"pred": F.col("p_retailprice") * F.col("l_quantity"), "truth": F.col("l_extendedprice")})


def _study(by: str, source: str = "j") -> str:
    return f"""r AS (SELECT *, pred / truth AS ratio FROM {source} WHERE truth > 0 AND pred IS NOT NULL), m AS (SELECT {by} AS g, median(ratio) AS m FROM r GROUP BY 1),
x AS (SELECT r.*, m.m, (ratio - m.m) / m.m AS y, log2((pred / m.m + truth) / 2) AS lx FROM r JOIN m ON m.g IS NOT DISTINCT FROM {by}),
s AS (SELECT {by} AS g, count(*) AS n, any_value(m) AS median_ratio, avg(ratio) AS mean_ratio, 100 * avg(abs(ratio - m)) / any_value(m) AS cod, avg(ratio) / (sum(pred) / sum(truth)) AS prd, regr_intercept(y, lx) AS prb_intercept, regr_slope(y, lx) AS prb_slope FROM x GROUP BY 1)"""


_STATS = ["median_ratio", "mean_ratio", "cod", "prd", "prb_intercept", "prb_slope"]
_ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in _STATS)


def _rounded(df, fields=None, places=8):
    return df.withColumns({c: F.round(c, places) for c in fields or _STATS})


@query(f"WITH {_J}, {_study('p_brand')} SELECT g AS p_brand, n, {_ROUNDED} FROM s")
def ratio_study(spark, d):
    return _rounded(ratios.ratio_study(_joined(spark, d), ["p_brand"], "pred", "truth"))


_TRIM = """q0 AS (SELECT *, pred / truth AS ratio FROM j WHERE truth > 0), b AS (SELECT quantile_cont(ratio, 0.25) AS a, quantile_cont(ratio, 0.75) AS z, quantile_cont(ratio, 0.025) AS qa, quantile_cont(ratio, 0.975) AS qz FROM q0),
o AS (SELECT avg((ratio < a - 1.5 * (z - a) OR ratio > z + 1.5 * (z - a))::INT) AS o FROM q0, b),
t AS (SELECT q0.* EXCLUDE (ratio) FROM q0, b, o WHERE ratio >= CASE WHEN o > 0.05 THEN qa ELSE a - 1.5 * (z - a) END AND ratio <= CASE WHEN o > 0.05 THEN qz ELSE z + 1.5 * (z - a) END)"""


@query(f"WITH {_J}, {_TRIM}, {_study('p_brand', 't')} SELECT g AS p_brand, n, {_ROUNDED} FROM s")
def ratio_trimmed(spark, d):
    with kept(_joined(spark, d).select("p_brand", "pred", "truth")) as j:
        r = ratios.trim(ratios.with_ratio(j, "pred", "truth"), "ratio").drop("ratio")
        return cut(_rounded(ratios.ratio_study(r, ["p_brand"], "pred", "truth", exact=True)))


@query(f"""WITH {_J}, n AS (SELECT p_size, count(*) AS n FROM j GROUP BY 1), k AS (SELECT j.* EXCLUDE (p_size), CASE WHEN n >= 1200 THEN j.p_size::VARCHAR ELSE 'other' END AS p_size FROM j JOIN n ON n.p_size = j.p_size), {_study('p_size', 'k')}
SELECT g AS p_size, n, {_ROUNDED} FROM s""")
def ratio_breakdown_category(spark, d):
    return _rounded(ratios.ratio_study(ratios.pooled(_joined(spark, d), "p_size", 1200), ["p_size"], "pred", "truth"))


@query(f"""WITH {_J}, e AS (SELECT list_distinct(quantile_cont(truth, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM j WHERE truth > 0), k AS (SELECT j.*, greatest(1, len(list_filter(e, lambda x: x < truth)))::INT AS bin FROM j, e), {_study('bin', 'k')}
SELECT g AS bin, n, {_ROUNDED} FROM s""")
def ratio_breakdown_quantile(spark, d):
    return _rounded(ratios.quantile_table(_joined(spark, d), "pred", "truth", 10))


@query(f"""WITH {_J}, k AS (SELECT *, (floor(truth / 20000) * 20000)::BIGINT::VARCHAR || ' - ' || (floor(truth / 20000) * 20000 + 20000)::BIGINT::VARCHAR AS slice FROM j), {_study('slice', 'k')} SELECT g AS slice, n, {_ROUNDED} FROM s""")
def ratio_breakdown_slice(spark, d):
    return _rounded(ratios.ratio_study(_joined(spark, d).withColumn("slice", bins.slice_label(F.col("truth"), 20000)), ["slice"], "pred", "truth"))


@query(f"""WITH {_J}, m AS (SELECT p_brand, p_type, median(truth) AS m FROM j GROUP BY 1, 2), c AS (SELECT 100 * avg(abs(truth - m)) / any_value(m) AS chd FROM j JOIN m USING (p_brand, p_type) GROUP BY p_brand, p_type HAVING count(*) > 1)
SELECT count(*) AS n, {", ".join(f"round(quantile_cont(chd, {p}), 6) AS chd_{s}" for p, s in ((0.0, 'min'), (0.05, 'p05'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.95, 'p95'), (1.0, 'max')))} FROM c""")
def chd_distribution(spark, d):
    df = _joined(spark, d).withColumn("cluster", F.concat_ws("_", "p_brand", "p_type"))
    got = ratios.chd_distribution(df, "cluster", "truth")
    return got.withColumns({c: F.round(c, 6) for c in got.columns if c != "n"})


@query(f"""WITH {_J}, r AS (SELECT p_brand, pred, truth, pred / truth AS ratio FROM j WHERE truth > 0), m AS (SELECT p_brand, median(ratio) AS m, count(*) AS n FROM r GROUP BY 1),
v AS (SELECT r.*, m.m, m.n, 0.5 * truth + 0.5 * pred / m.m AS v, CASE WHEN n <= 50 THEN 2 WHEN n <= 500 THEN 4 ELSE 10 END AS g FROM r JOIN m USING (p_brand) WHERE n >= 20),
e AS (SELECT p_brand, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS e FROM v GROUP BY 1),
w AS (SELECT v.*, CASE g WHEN 2 THEN e[3] WHEN 4 THEN e[2] ELSE e[1] END AS lo, CASE g WHEN 2 THEN e[3] WHEN 4 THEN e[4] ELSE e[5] END AS hi FROM v JOIN e USING (p_brand))
SELECT p_brand, any_value(n) AS n, any_value(g)::INT AS groups, round(100 * (median(ratio) FILTER (v > hi) - median(ratio) FILTER (v <= lo)) / any_value(m), 8) AS vei FROM w GROUP BY 1""")
def vei(spark, d):
    return ratios.vertical_equity(_joined(spark, d), ["p_brand"], "pred", "truth").withColumn("vei", F.round("vei", 8))


@query(f"""WITH {_J}, s AS (SELECT p_type, count(*) AS n, avg((pred - truth) ** 2) AS mse, avg(abs(pred - truth) / truth) AS mape, var_pop(truth) AS vt, covar_pop(pred, truth) AS c, var_pop(pred) AS vp FROM j WHERE truth > 0 GROUP BY 1)
SELECT p_type, n, round(mse, 2) AS mse, round(sqrt(mse), 4) AS rmse, round(mape, 8) AS mape, round(1 - mse / vt, 8) AS r2, round(1 - (mse / vt) * (n - 1) / (n - 2), 8) AS adj_r2, round(c / vp, 8) AS slope FROM s""")
def model_metrics(spark, d):
    got = ratios.fit_metrics(_joined(spark, d), ["p_type"], "pred", "truth")
    return got.withColumns({c: F.round(c, k) for c, k in {"mse": 2, "rmse": 4, "mape": 8, "r2": 8, "adj_r2": 8, "slope": 8}.items()})


_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size"]


@query(f"WITH {_J}, k AS (SELECT l_quantity, truth AS l_extendedprice, l_discount, l_tax, p_size::DOUBLE AS p_size FROM j) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM k" for i, a in enumerate(_FIELDS) for b in _FIELDS[i + 1 :]))
def corr_matrix(spark, d):
    return ratios.correlations(_joined(spark, d), _FIELDS).withColumn("corr", F.round("corr", 8))


@query(f"WITH {_J}, k AS (SELECT l_quantity, truth AS y, l_discount, l_tax, p_size::DOUBLE AS p_size FROM j) " + " UNION ALL ".join(
    f"SELECT '{x}' AS variable, count(*) AS n, round(regr_r2(y, {x}), 8) AS r2, round(1 - (1 - regr_r2(y, {x})) * (count(*) - 1) / (count(*) - 2), 8) AS adj_r2, round(regr_slope(y, {x}), 6) AS slope, round(regr_intercept(y, {x}), 4) AS intercept FROM k" for x in ("l_quantity", "l_discount", "l_tax", "p_size")))
def univariate_ols(spark, d):
    got = ratios.univariate(_joined(spark, d), "truth", ["l_quantity", "l_discount", "l_tax", "p_size"])
    return got.withColumns({c: F.round(c, k) for c, k in {"r2": 8, "adj_r2": 8, "slope": 6, "intercept": 4}.items()})


@query(f"""WITH {_J}, {_study('p_brand')}, u AS (SELECT g, n, median_ratio AS r, cod, cod / 2 AS chd FROM s)
SELECT g AS p_brand, round(CASE WHEN r < 1.05 THEN abs(r - 1) * 1000 ELSE 2 * abs(r - 1) * 1000 END + 1.5 * cod + chd + CASE WHEN cod > 0 THEN 7.5 * chd / cod ELSE 0 END, 6) AS utility FROM u""")
def utility_score(spark, d):
    s = ratios.ratio_study(_joined(spark, d), ["p_brand"], "pred", "truth")
    return s.select("p_brand", F.round(ratios.utility(ratio=F.col("median_ratio"), cod=F.col("cod"), chd=F.col("cod") / 2), 6).alias("utility"))


@query("""WITH v AS (SELECT land_value AS l, bldg_value AS b, total_value AS t, is_vacant FROM universe)
SELECT count(*) AS n, round(avg((l IS NULL OR isnan(l))::INT), 8) AS null_share, round(avg(coalesce(l < 0, false)::INT), 8) AS negative_share, round(avg((coalesce(l > t, false) AND NOT coalesce(isnan(l), false))::INT), 8) AS overshoot_share,
round(avg((coalesce(abs(l + b - t) > 1, false) AND NOT coalesce(isnan(l + b - t), false))::INT), 8) AS not_adding_up_share FROM v""")
def land_sanity(spark, d):
    u = table(spark, d, "universe").select(F.col("land_value").alias("l"), F.col("bldg_value").alias("b"), F.col("total_value").alias("t"))
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 8).alias(n)
    gap = F.col("l") + F.col("b") - F.col("t")
    return u.agg(F.count(F.lit(1)).alias("n"), share(F.col("l").isNull() | F.isnan("l"), "null_share"), share(F.col("l") < 0, "negative_share"), share((F.col("l") > F.col("t")) & ~F.isnan("l"), "overshoot_share"), share((F.abs(gap) > 1) & ~F.isnan(gap), "not_adding_up_share"))


@query("""WITH s AS (SELECT row_id, model_group, sale_price AS p FROM sales WHERE sale_price > 0 AND NOT isnan(sale_price) AND model_group IS NOT NULL),
w AS (SELECT row_id, model_group, p, count(p) OVER c AS n, median(p) OVER c AS median, stddev_samp(p) OVER c AS std FROM s WINDOW c AS (PARTITION BY model_group))
SELECT row_id, n, median, p / median AS ratio, coalesce(abs((p - median) / std) > 2 OR p / median >= 4 OR (p / median <= 0.35 AND (p - median) / std < -1), false) AS flag FROM w""")
def scrutiny_flags(spark, d):
    s = table(spark, d, "sales").where("sale_price > 0 and not isnan(sale_price) and model_group is not null").select("row_id", "model_group", F.col("sale_price").alias("p"))
    return ratios.scrutiny(s, "model_group", "p").select("row_id", "n", "median", "ratio", "flag")


@query()
def bootstrap_intervals(spark, d):
    return ratios.bootstrap(_joined(spark, d), "pred", "truth", replicates=50)


@query()
def correlation_choice(spark, d):
    kept = ratios.choose_by_correlation(ratios.correlations(_joined(spark, d), _FIELDS), "l_extendedprice")
    return spark.createDataFrame(list(enumerate(kept)), "place int, field string")


@query()
def bimodal_clusters(spark, d):
    s = table(spark, d, "sales").where("sale_price > 0 and not isnan(sale_price)").select("model_group", "sale_price")
    return ratios.two_humps(s, "model_group", "sale_price")
