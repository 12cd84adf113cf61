"""Exact k nearest neighbours on a grid of growing cells, spatial lags, nearest features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"__cx": F.floor(F.col(x) / size), "__cy": F.floor(F.col(y) / size)})


def k_nearest(points: DataFrame, sample: DataFrame, point_id: str, sample_id: str, x: str, y: str, k: int, skip_same: bool = False) -> DataFrame:
    """``point_id, sample_id, distance, place`` (1..k) of the nearest sample rows to every point (planar; ties by ``sample_id``).

    A point looks at its cell and the eight around it; if its k-th neighbour found is no further than a cell is wide,
    none can be nearer outside, so it is done. The rest look again in cells twice as wide, until all are done or one
    cell holds everything. With ``skip_same`` a sample row with the point's own id is no neighbour. Points or sample
    rows without coordinates take no part.
    """
    ok = lambda df: df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    s = cut(ok(sample).select(F.col(sample_id).alias("__sid"), F.col(x).cast("double").alias("__sx"), F.col(y).cast("double").alias("__sy")))
    todo = cut(ok(points).select(F.col(point_id).alias("__pid"), F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py")))
    box = s.agg(F.count(F.lit(1)), F.min("__sx"), F.max("__sx"), F.min("__sy"), F.max("__sy")).first()
    far = todo.agg(F.min("__px"), F.max("__px"), F.min("__py"), F.max("__py")).first()
    if not box[0] or far[0] is None:
        return todo.limit(0).select(F.col("__pid").alias(point_id), F.lit(None).cast(dict(s.dtypes)["__sid"]).alias(sample_id), F.lit(0.0).alias("distance"), F.lit(1).alias("place"))
    extent = max(max(box[2], far[1]) - min(box[1], far[0]), max(box[4], far[3]) - min(box[3], far[2]), 1e-9)
    size = max(extent * (k / box[0]) ** 0.5, extent * 1e-6)  # about k rows in a cell if they lay evenly
    done = None
    while True:
        last = size >= extent * 1.01
        p = _cells(todo, "__px", "__py", size).withColumn("__d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
        p = p.select("__pid", "__px", "__py", (F.col("__cx") + F.col("__d.i")).alias("__cx"), (F.col("__cy") + F.col("__d.j")).alias("__cy"))
        j = p.join(_cells(s, "__sx", "__sy", size), ["__cx", "__cy"])
        if skip_same:
            j = j.where(F.col("__pid") != F.col("__sid"))
        dist = F.sqrt(F.pow(F.col("__px") - F.col("__sx"), 2) + F.pow(F.col("__py") - F.col("__sy"), 2))
        near = j.select("__pid", "__sid", dist.alias("distance")).withColumn("place", F.row_number().over(Window.partitionBy("__pid").orderBy("distance", "__sid"))).where(F.col("place") <= k)
        near = cut(near)
        sure = near.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("m"))
        sure = sure if last else sure.where((F.col("n") == k) & (F.col("m") <= size))
        got = near.join(sure.select("__pid"), "__pid", "left_semi")
        done = got if done is None else done.unionByName(got)
        if last:
            break
        todo = cut(todo.join(sure.select("__pid"), "__pid", "left_anti"))
        if todo.isEmpty():
            break
        size *= 2
    return done.select(F.col("__pid").alias(point_id), F.col("__sid").alias(sample_id), "distance", "place")


def spatial_lag(points: DataFrame, sample: DataFrame, point_id: str, sample_id: str, x: str, y: str, fields: list[str], k: int = 5, skip_same: bool = False) -> DataFrame:
    """``point_id``, ``lag_<field>`` per field and ``lag_confidence``: neighbours' values weighted by exp(-d^2 / 2 s^2) with s
    the point's mean distance (equal weights where it is 0); null values weigh nothing. Confidence is
    1 - (k / D^2) / sum(1 / d^2) within [0, 1], D half a mile in degrees."""
    near = k_nearest(points, sample, point_id, sample_id, x, y, k, skip_same)
    mean = near.groupBy(point_id).agg(F.avg("distance").alias("__s"))
    v = near.join(mean, point_id).join(sample.select(sample_id, *fields), sample_id)
    w = F.when(F.col("__s") > 0, F.exp(-F.pow(F.col("distance"), 2) / (2 * F.pow("__s", 2)))).otherwise(1.0)
    v = v.withColumn("__w", w)
    lag = [F.try_divide(F.sum(F.when(F.col(f).isNotNull(), F.col("__w") * F.col(f))), F.sum(F.when(F.col(f).isNotNull(), F.col("__w")))).alias(f"lag_{f}") for f in fields]
    half_mile = 0.5 / 69.0
    closeness = F.sum(F.when(F.col("distance") > 0, 1 / F.pow("distance", 2)).otherwise(1e12))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.lit(k / half_mile**2) / closeness))
    return v.groupBy(point_id).agg(*lag, conf.alias("lag_confidence"))


def nearest_feature(points: DataFrame, features: DataFrame, point_id: str, feature_id: str, x: str, y: str, limit: float) -> DataFrame:
    """Every point with ``distance`` to the nearest feature within ``limit`` (else null; ties by ``feature_id``), ``within`` and
    ``proximity`` = limit - distance (else 0).

    Places are compared, not rows: equal coordinates are one place, and of its features the least id counts. A place looks
    at its cell and the eight around it; if the nearest feature found is no further than a cell is wide, none outside can
    be nearer or as near. The rest look again in cells twice as wide, the last ones ``limit`` wide. The first cells
    are so small that a feature shares its own with few others, where the features crowd.
    """
    xy = lambda df, p: df.withColumns({f"__{p}x": F.col(x).cast("double") + F.lit(0.0), f"__{p}y": F.col(y).cast("double") + F.lit(0.0)})
    known = lambda df, p: df.where(" and ".join(f"__{p}{c} is not null and not isnan(__{p}{c})" for c in "xy"))
    p = xy(points, "p")
    f = cut(known(xy(features, "f"), "f").where(F.col(feature_id).isNotNull()).groupBy("__fx", "__fy").agg(F.min(feature_id).alias("__fid")))
    todo = cut(known(p, "p").select("__px", "__py").distinct())
    # a little wider than the limit, as divisions round
    size = limit * (1 + 1e-9)
    rounds = 0
    while rounds < 40:
        n = _cells(f, "__fx", "__fy", size / 2**rounds).groupBy("__cx", "__cy").agg(F.count(F.lit(1)).cast("double").alias("n"))
        crowd = n.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c")).first()["c"] or 1.0
        if crowd <= 4:
            break
        rounds += math.ceil(math.log2(crowd) / 2)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    dist = F.sqrt(F.pow(F.col("__px") - F.col("__fx"), 2) + F.pow(F.col("__py") - F.col("__fy"), 2))
    done = None
    for k in range(rounds, -1, -1):
        wide = size / 2**k
        c = _cells(f, "__fx", "__fy", wide).withColumn("__d", around)
        c = c.select("__fid", "__fx", "__fy", (F.col("__cx") + F.col("__d.i")).alias("__cx"), (F.col("__cy") + F.col("__d.j")).alias("__cy"))
        near = _cells(todo, "__px", "__py", wide).join(c, ["__cx", "__cy"]).select("__px", "__py", "__fid", dist.alias("distance"))
        best = near.groupBy("__px", "__py").agg(F.min(F.struct("distance", "__fid")).alias("b")).select("__px", "__py", "b.*")
        sure = cut(best.where(F.col("distance") <= (wide * (1 - 1e-6) if k else limit)))
        done = sure if done is None else done.unionByName(sure)
        if k:
            todo = cut(todo.join(sure, ["__px", "__py"], "left_anti"))
            if todo.isEmpty():
                break
    got = p.select(point_id, "__px", "__py").join(done, ["__px", "__py"], "left").select(point_id, "distance", F.col("__fid").alias(feature_id))
    return got.withColumns({"within": F.col("distance").isNotNull(), "proximity": F.coalesce(F.lit(limit) - F.col("distance"), F.lit(0.0))})


def local_regression(points: DataFrame, train: DataFrame, point_id: str, train_id: str, x: str, y: str, xs: list[str], target: str, k: int = 30) -> DataFrame:
    """``point_id, prediction``: weighted least squares on each point's ``k`` nearest training rows with bisquare weights.

    Neighbours come from the grid; each point's normal equations are summed in the JVM, only their solution is numpy.
    """
    from plumbline.operators.predict import _solve

    near = k_nearest(points, train, point_id, train_id, x, y, k)
    reach = near.groupBy(point_id).agg(F.max("distance").alias("__h"))
    v = near.join(reach, point_id).join(train.select(train_id, target, *xs), train_id)
    v = v.withColumn("__w", F.when(F.col("__h") > 0, F.pow(1 - F.pow(F.col("distance") / (F.col("__h") * 1.0001), 2), 2)).otherwise(1.0))
    cols: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    ok = F.col(target).isNotNull()
    for c in xs:
        ok = ok & F.col(c).isNotNull()
    sums = [F.sum(F.col("__w") * cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    g = v.where(ok).groupBy(point_id).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(F.col("__w") * c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols)], F.sum(F.col("__w") * F.col(target) * F.col(target)).alias("yy"))
    kind, size = dict(g.dtypes)[point_id], len(xs)

    def run(batches):
        for pdf in batches:
            yield _solve(pdf, [point_id], size)

    fits = g.mapInPandas(run, f"{point_id} {kind}, n long, coef array<double>, t array<double>, r2 double")
    from plumbline.operators.predict import apply_linear

    return apply_linear(points.select(point_id, *xs), fits, xs, [point_id]).select(point_id, "prediction")


def kernel_regression(points: DataFrame, train: DataFrame, point_id: str, train_id: str, x: str, y: str, target: str, width: float, k: int = 50, features: dict[str, float] | None = None) -> DataFrame:
    """``point_id, prediction``: the mean of the ``k`` nearest training values weighted by a Gaussian of the distance (``width``)
    and of each feature's difference (its own width)."""
    fs = features or {}
    near = k_nearest(points, train, point_id, train_id, x, y, k)
    t = train.select(train_id, F.col(target).alias("__t"), *[F.col(f).alias(f"__t_{f}") for f in fs])
    j = near.join(t, train_id).join(points.select(point_id, *fs), point_id).where("`__t` is not null")
    e = F.pow(F.col("distance") / width, 2)
    for f, w in fs.items():
        e = e + F.coalesce(F.pow((F.col(f) - F.col(f"__t_{f}")) / w, 2), F.lit(0.0))
    j = j.withColumn("__w", F.exp(-e / 2))
    return j.groupBy(point_id).agg(F.try_divide(F.sum(F.col("__w") * F.col("__t")), F.sum("__w")).alias("prediction"))


def modal_group(parcels: DataFrame, areas: DataFrame, key: str, lat: str, lon: str, group: str, area_id: str, geometry: str) -> DataFrame:
    """``area_id, group``: the most frequent group (then the smallest) of the parcels whose point lies in each area."""
    from plumbline.operators.spatial import regions_of

    inside = regions_of(parcels.where(F.col(group).isNotNull()).select(key, lat, lon, group), lat, lon, areas, area_id, geometry)
    n = inside.groupBy("region", group).agg(F.count_distinct(key).alias("n"))
    return n.groupBy("region").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(group).alias("g"))).alias("b")).select(F.col("region").alias(area_id), F.col("b.g").alias(group))
