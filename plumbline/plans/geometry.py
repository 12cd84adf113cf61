"""Queries of spatial, planar and income expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geo, income, planar
from plumbline.operators import neighbors
from plumbline.plans.registry import Family
from plumbline.plans.tables import table

family = Family()
query = family.query

_XY = "xy AS (SELECT c_custkey AS id, 29 + (c_custkey * 37 % 1000) / 1000.0 AS lat, -95 + (c_custkey * 91 % 997) / 1000.0 AS lon, c_acctbal AS v FROM customer)"


def _xy(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (29 + (k * 37 % 1000) / 1000.0).alias("lat"), (-95 + (k * 91 % 997) / 1000.0).alias("lon"), F.col("c_acctbal").alias("v"))


_HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(29.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(29.5)) * pow(sin(radians(-94.5 - lon) / 2), 2)))"


@query(f"WITH {_XY} SELECT id, round({_HAV}, 4) AS metres FROM xy")
def haversine(spark, d):
    return _xy(spark, d).select("id", F.round(geo.great_circle_m(F.col("lat"), F.col("lon"), F.lit(29.5), F.lit(-94.5)), 4).alias("metres"))


@query(f"WITH {_XY} SELECT id, round(sqrt((lon + 94.5) ** 2 + (lat - 29.5) ** 2), 10) AS radius, round(degrees(atan2(lat - 29.5, lon + 94.5)), 8) AS angle FROM xy")
def polar(spark, d):
    r, a = planar.polar(F.col("lon"), F.col("lat"), -94.5, 29.5)
    return _xy(spark, d).select("id", F.round(r, 10).alias("radius"), F.round(a, 8).alias("angle"))


@query("SELECT c_custkey, (c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer) AS c_acctbal_norm, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 10) END AS log_bal FROM customer")
def minmax_norm(spark, d):
    got = planar.min_max(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return got.select("c_custkey", "c_acctbal_norm", F.when(F.col("c_acctbal") > 0, F.round(F.ln("c_acctbal"), 10)).alias("log_bal"))


@query(f"""WITH {_XY}, s AS (SELECT id AS sid, lat AS slat, lon AS slon, v FROM xy), j AS (SELECT id, sid, s.v, sqrt((lon - slon) ** 2 + (lat - slat) ** 2) AS d FROM xy, s WHERE id <> sid),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS r FROM j QUALIFY r <= 5) SELECT id, sid, round(d, 12) AS distance, r::INT AS place FROM n""")
def knn(spark, d):
    xy = _xy(spark, d)
    got = neighbors.k_nearest(xy, xy.withColumnRenamed("id", "sid"), "id", "sid", "lon", "lat", 5, skip_same=True)
    return got.withColumn("distance", F.round("distance", 12))


@query(f"""WITH {_XY}, s AS (SELECT id AS sid, lat AS slat, lon AS slon, v FROM xy), j AS (SELECT id, sid, s.v, sqrt((lon - slon) ** 2 + (lat - slat) ** 2) AS d FROM xy, s WHERE id <> sid),
n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, sid) <= 5), m AS (SELECT id, avg(d) AS s FROM n GROUP BY 1), w AS (SELECT n.*, CASE WHEN s > 0 THEN exp(-(d ** 2) / (2 * s ** 2)) ELSE 1 END AS w FROM n JOIN m USING (id))
SELECT id, round(sum(w * v) / sum(w), 6) AS lag_v, round(greatest(0, least(1, 1 - (5 / (0.5 / 69.0) ** 2) / sum(CASE WHEN d > 0 THEN 1 / d ** 2 ELSE 1e12 END))), 8) AS lag_confidence FROM w GROUP BY 1""")
def knn_lag(spark, d):
    xy = _xy(spark, d)
    got = neighbors.spatial_lag(xy.drop("v"), xy.withColumnRenamed("id", "sid"), "id", "sid", "lon", "lat", ["v"], 5, skip_same=True)
    return got.withColumns({"lag_v": F.round("lag_v", 6), "lag_confidence": F.round("lag_confidence", 8)})


@query(f"""WITH {_XY}, f AS (SELECT s_suppkey AS fid, 29 + (s_suppkey * 53 % 1000) / 1000.0 AS flat, -95 + (s_suppkey * 71 % 997) / 1000.0 AS flon FROM supplier), j AS (SELECT id, fid, sqrt((lon - flon) ** 2 + (lat - flat) ** 2) AS d FROM xy, f), n AS (SELECT * FROM j WHERE d <= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, fid) = 1)
SELECT xy.id, n.fid, round(d, 10) AS distance, d IS NOT NULL AS within, round(coalesce(0.1 - d, 0), 10) AS proximity FROM xy LEFT JOIN n ON n.id = xy.id""")
def nearest_feature(spark, d):
    xy = _xy(spark, d)
    k = F.col("s_suppkey")
    f = table(spark, d, "supplier").select(k.alias("fid"), (29 + (k * 53 % 1000) / 1000.0).alias("lat"), (-95 + (k * 71 % 997) / 1000.0).alias("lon"))
    got = neighbors.nearest_feature(xy, f, "id", "fid", "lon", "lat", 0.1)
    return got.withColumns({"distance": F.round("distance", 10), "proximity": F.round("proximity", 10)})


@query("""WITH t AS (SELECT p_partkey, p_size * 4.0 AS depth, 10 + p_partkey % 90 AS front, p_retailprice AS v FROM part), u AS (SELECT *, CASE WHEN depth = 100 THEN 1.0 WHEN depth <= 0 THEN 0.0 ELSE floor(1.336 * (1 - exp(-0.0326 * pow(depth, 0.813))) * 1000 + 0.5) / 1000 END AS pct FROM t)
SELECT p_partkey, pct::DOUBLE AS pct, round(pct * front, 8) AS units, round(CASE WHEN pct * front <> 0 THEN v / (pct * front) END, 8) AS per_unit FROM u""")
def somers(spark, d):
    depth, front = F.col("p_size") * 4.0, (10 + F.col("p_partkey") % 90).cast("double")
    return table(spark, d, "part").select("p_partkey", planar.depth_percent(depth).alias("pct"), F.round(planar.unit_feet(front, depth), 8).alias("units"), F.round(planar.value_per_unit(F.col("p_retailprice"), front, depth), 8).alias("per_unit"))


_G = "(0.01 + p_size / 1000.0)"


@query(f"""WITH t AS (SELECT p_partkey, p_retailprice * 0.06 AS noi, {_G} AS g FROM part), x AS (SELECT *, noi * pow(1 + g, 5) / 0.07 AS ex FROM t)
SELECT p_partkey, round(noi, 8) AS noi, round(ex / pow(1.09, 5) + {" + ".join(f"noi * pow(1 + g, {t}) / pow(1.09, {t + 1})" for t in range(5))}, 6) AS entry_price, round(ex, 6) AS exit_price, round((1 + g) * 1.02 - 1, 10) AS noi_growth, round((1 + g) / 1.03 - 1, 10) AS cap_rate_growth FROM x""")
def dcf_price(spark, d):
    g = F.lit(0.01) + F.col("p_size") / 1000.0
    n = income.noi(F.col("p_retailprice"), F.lit(0.06))
    entry, exit_ = income.prices(F.lit(0.09), F.lit(0.07), n, g, 5)
    return table(spark, d, "part").select("p_partkey", F.round(n, 8).alias("noi"), F.round(entry, 6).alias("entry_price"), F.round(exit_, 6).alias("exit_price"), F.round(income.noi_growth(g, F.lit(0.02)), 10).alias("noi_growth"), F.round(income.cap_rate_growth(F.lit(0.03), g), 10).alias("cap_rate_growth"))


@query("SELECT p_partkey, 0.09::DOUBLE AS irr, round(0.01 + p_size / 1000.0, 8)::DOUBLE AS growth FROM part")
def irr_round_trip(spark, d):
    """Returns and growth found by bisection give back what the prices were made with."""
    g = F.lit(0.01) + F.col("p_size") / 1000.0
    n = F.col("p_retailprice") * 0.06
    p = table(spark, d, "part").withColumns({"g": g, "n": n})
    entry, exit_ = income.prices(F.lit(0.09), F.lit(0.07), F.col("n"), F.col("g"), 5)
    p = p.withColumns({"entry": entry, "exit": exit_}).withColumn("cap", F.col("n") / F.col("entry"))
    return p.select("p_partkey", F.round(income.irr(F.col("entry"), F.col("exit"), F.col("cap"), F.col("g"), 5), 8).alias("irr"), F.round(income.implied_growth(F.lit(0.09), F.lit(0.07), F.col("entry"), F.col("cap"), 5), 8).alias("growth"))


@query("SELECT record_id, census_block_group, substr(census_block_group, 1, 11) AS tract FROM universe WHERE length(census_block_group) = 12")
def census_geoid(spark, d):
    return table(spark, d, "universe").where("length(census_block_group) = 12").select("record_id", "census_block_group", F.substring("census_block_group", 1, 11).alias("tract"))


@query(f"WITH {_XY} SELECT id, lon <= -94.2 AND -94.6 <= lon + 0.05 AND lat <= 29.8 AND 29.3 <= lat + 0.05 AS meets FROM xy")
def box_overlap(spark, d):
    b = [F.lit(v) for v in (-94.6, 29.3, -94.2, 29.8)]
    return _xy(spark, d).select("id", planar.overlaps(F.col("lon"), F.col("lat"), F.col("lon") + 0.05, F.col("lat") + 0.05, *b).alias("meets"))


@query(f"WITH {_XY} SELECT id, greatest(0, 1 - sqrt((lon + 94.5) ** 2 + (lat - 29.5) ** 2)) AS linear, round(1 / pow(1 + sqrt((lon + 94.5) ** 2 + (lat - 29.5) ** 2), 2), 10) AS inverse, round(exp(-2 * sqrt((lon + 94.5) ** 2 + (lat - 29.5) ** 2)), 10) AS exponential FROM (SELECT * FROM xy)")
def value_surfaces(spark, d):
    r = F.sqrt(F.pow(F.col("lon") + 94.5, 2) + F.pow(F.col("lat") - 29.5, 2))
    return _xy(spark, d).select("id", planar.decay("linear", r).alias("linear"), F.round(planar.decay("inverse_square", r), 10).alias("inverse"), F.round(planar.decay("exponential", r, 2.0), 10).alias("exponential"))


@query(f"WITH {_XY} SELECT id, 12000.0::DOUBLE AS area FROM xy")
def rectangle_area(spark, d):
    """Rectangles of 100 m by 120 m about points, projected with equal area: their area comes back (to 1 m2)."""
    xy = _xy(spark, d).withColumn("ring", planar.rectangle(F.col("lat"), F.col("lon"), 100.0, 120.0))
    pt = lambda p: F.struct(*[c.alias(n) for c, n in zip(planar.equal_area_xy(p["y"], p["x"], 29.5, -94.5), "xy", strict=True)])
    return xy.select("id", F.round(planar.ring_area(F.transform("ring", pt)), 0).alias("area"))


@query()
def gwr_model(spark, d):
    xy = _xy(spark, d).withColumns({"f": F.col("id") % 13 + F.lit(0.0)})
    return neighbors.local_regression(xy, xy.withColumnRenamed("id", "tid"), "id", "tid", "lon", "lat", ["f"], "v", 20)


@query()
def parcel_shapes(spark, d):
    from plumbline.operators import shapes

    return shapes.shape_metrics(table(spark, d, "universe").select("record_id", "geometry"), "record_id", "geometry")


@query()
def covered_area(spark, d):
    """The area of parcels within each block group."""
    from plumbline.operators import shapes

    return shapes.covered_area(table(spark, d, "block_groups").select("std_geoid", "geometry"), table(spark, d, "universe").where("geometry is not null").select("record_id", "geometry"), "std_geoid", "record_id", "geometry")


@query()
def hilbert_order(spark, d):
    from plumbline.operators import shapes

    return table(spark, d, "universe").select("record_id", shapes.hilbert_code(F.col("longitude"), F.col("latitude")).alias("place"))


@query()
def point_in_region(spark, d):
    """Geocoding: the block group of each stored coordinate."""
    from plumbline.operators import spatial

    u = table(spark, d, "universe").select("record_id", "latitude", "longitude")
    return spatial.regions_of(u, "latitude", "longitude", table(spark, d, "block_groups"), "std_geoid", "geometry").select("record_id", "region")


_KERNEL = "j AS (SELECT xy.id, t.id AS tid, t.v, sqrt((xy.lon - t.lon) ** 2 + (xy.lat - t.lat) ** 2) AS d FROM xy, xy t)"


@query(f"WITH {_XY}, {_KERNEL}, n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, tid) <= 20) SELECT id, round(sum(exp(-((d / 0.05) ** 2) / 2) * v) / sum(exp(-((d / 0.05) ** 2) / 2)), 6) AS prediction FROM n GROUP BY 1")
def kernel_model(spark, d):
    xy = _xy(spark, d)
    got = neighbors.kernel_regression(xy, xy.withColumnRenamed("id", "tid"), "id", "tid", "lon", "lat", "v", 0.05, 20)
    return got.withColumn("prediction", F.round("prediction", 6))


@query()
def modal_groups(spark, d):
    u = table(spark, d, "universe").select("record_id", "latitude", "longitude", "model_group")
    return neighbors.modal_group(u, table(spark, d, "block_groups"), "record_id", "latitude", "longitude", "model_group", "std_geoid", "geometry")


_FRONT = """k AS (SELECT c_custkey AS key, (c_custkey % 40) * 20.0 AS x, (c_custkey // 40) * 50.0 AS y FROM customer)"""


@query(f"WITH {_FRONT}, m AS (SELECT max(y) AS m FROM k) SELECT key, (y // 50)::BIGINT AS road, 20.0::DOUBLE AS frontage, 5.0::DOUBLE AS set_back, 'S' AS facing FROM k")
def street_frontage(spark, d):
    """Lots of 20 m by 35 m in rows, each 5 m behind its road: every lot fronts its road with its whole width, facing south."""
    from plumbline.operators import frontage

    k = F.col("c_custkey")
    lots = table(spark, d, "customer").select(k.alias("key"), ((k % 40) * 20.0).alias("x"), (F.floor(k / 40) * 50.0).alias("y"))
    sides = F.explode(F.array(*[F.struct(*[(F.col(c) + v).alias(n) for n, c, v in (("ax", "x", a), ("ay", "y", b), ("bx", "x", e), ("by", "y", f))]) for a, b, e, f in ((0.0, 5.0, 20.0, 5.0), (20.0, 5.0, 20.0, 40.0), (20.0, 40.0, 0.0, 40.0), (0.0, 40.0, 0.0, 5.0))])).alias("s")
    roads = lots.select(F.floor(F.col("y") / 50).alias("road"), "y").distinct().select("road", F.lit(0.0).alias("x1"), F.col("y").alias("y1"), F.lit(800.0).alias("x2"), F.col("y").alias("y2"))
    # rays to the south meet the backs of the row below, 10 m away; those fronts face north and are another side of the story
    got = frontage.frontages(roads, lots.select("key", sides).select("key", "s.*"), "road", "key")
    return got.where("facing = 'S'").select("key", "road", F.round("frontage", 6).alias("frontage"), F.round("set_back", 6).alias("set_back"), "facing")


@query()
def largest_overlapping(spark, d):
    """The best quality of the parcels that share area with each block group."""
    from plumbline.operators import shapes

    u = table(spark, d, "universe").where("geometry is not null").select("record_id", "geometry", "bldg_quality_num")
    return shapes.largest_of(table(spark, d, "block_groups").select("std_geoid", "geometry"), u, "std_geoid", "record_id", "geometry", ["bldg_quality_num"])
