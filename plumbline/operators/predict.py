"""Baseline, area, linear and tree predictions; ensembles; encodings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import quantiles
from plumbline.operators.skew import checked_join, null_safe_join


def constant(train: DataFrame, rows: DataFrame, y: str, how: str = "median", out: str = "prediction") -> DataFrame:
    """The mean or median of the training values for every row."""
    one = train.agg((F.avg if how == "mean" else F.median)(y).alias(out))
    return rows.crossJoin(F.broadcast(one))  # one row


def local_area(train: DataFrame, rows: DataFrame, y: str, area: str, locations: list[str], out: str = "prediction") -> DataFrame:
    """Area times the median rate of the first listed location that has a non-zero one, else of all rows."""
    got = rows
    # the filters of later passes are pushed below joins of the training rows, as try_divide never raises
    rates = train.where(F.col(area) > 0).select(*locations, F.try_divide(y, area).alias("__rate"))
    *local, all_rows = quantiles.medians(rates, [*[[loc] for loc in locations], []], "__rate", [*[f"__r{i}" for i in range(len(locations))], "__all"])
    for loc, r in zip(locations, local, strict=True):
        got = checked_join(got, r, loc, "left")
    got = got.crossJoin(F.broadcast(all_rows))
    rate = F.coalesce(*[F.nullif(F.col(f"__r{i}"), F.lit(0.0)) for i in range(len(locations))], F.col("__all"))
    return got.withColumn(out, F.col(area) * rate).drop(*[f"__r{i}" for i in range(len(locations))], "__all")


def one_hot(df: DataFrame, field: str, values: list, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per value but the first (in order); unseen and null values are all zeros."""
    return df.withColumns({f"{prefix or field}_{v}": F.coalesce((F.col(field) == v).cast("int"), F.lit(0)) for v in sorted(values)[1:]})


def gram(df: DataFrame, xs: list[Column], y: Column, by: list[str] | None = None) -> DataFrame:
    """The sums that a least-squares fit needs, per group: one partially aggregated pass, a row of (k + 1)^2 / 2 numbers."""
    cols = [F.lit(1.0), *xs]
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.where(ok).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(c * y).alias(f"b{i}") for i, c in enumerate(cols)], F.sum(y * y).alias("yy"))


def _solve(pdf, by: list[str], k: int):
    import numpy as np
    import pandas as pd

    out = []
    for _, r in pdf.iterrows():
        a = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
        b = np.array([r[f"b{i}"] for i in range(k + 1)], float)
        coef, *_ = np.linalg.lstsq(a, b, rcond=None)
        sse = max(0.0, float(r["yy"] - 2 * coef @ b + coef @ a @ coef))
        sst = float(r["yy"] - b[0] ** 2 / r["n"])
        inv = np.linalg.pinv(a)
        dof = max(1.0, float(r["n"]) - k - 1)
        se = np.sqrt(np.maximum(0.0, np.diag(inv) * sse / dof))
        t = np.divide(coef, se, out=np.zeros_like(coef), where=se > 0)
        out.append([r[c] for c in by] + [int(r["n"]), coef.tolist(), t.tolist(), 1 - sse / sst if sst > 0 else None])
    return pd.DataFrame(out, columns=[*by, "n", "coef", "t", "r2"])


def linear(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares per group: ``by, n, coef`` (intercept first)``, t, r2``. Only the sums of each group are solved in Python.

    Features are shifted by their overall means first (one row comes to the driver), so large offsets cost no precision.
    """
    by = by or []
    means = df.agg(*[F.avg(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(xs)], F.count(F.lit(1)).alias("n")).first()
    shift = [means[i] if means[i] is not None and means[i] == means[i] else 0.0 for i in range(len(xs))]
    g = gram(df, [F.col(x).cast("double") - F.lit(s) for x, s in zip(xs, shift, strict=True)], F.col(y).cast("double"), by)
    kinds = dict(g.dtypes)

    def run(batches: Iterator):
        for pdf in batches:
            out = _solve(pdf, by, len(xs))
            out["coef"] = [[c[0] - sum(a * s for a, s in zip(c[1:], shift, strict=True)), *c[1:]] for c in out["coef"]]
            yield out

    return g.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long, coef array<double>, t array<double>, r2 double"]))


def apply_linear(rows: DataFrame, fits: DataFrame, xs: list[str], by: list[str] | None = None, out: str = "prediction") -> DataFrame:
    """Predictions of each row's group; null without a fit or with a null feature."""
    f = fits.select(*(by or []), F.col("coef").alias("__coef"))
    got = null_safe_join(rows, f, by, "left") if by else rows.crossJoin(F.broadcast(f))
    value = F.col("__coef")[0]
    for i, x in enumerate(xs):
        value = value + F.col("__coef")[i + 1] * F.col(x)
    return got.withColumn(out, value).drop("__coef")


def per_location_linear(train: DataFrame, rows: DataFrame, xs: list[str], y: str, location: str, out: str = "prediction") -> DataFrame:
    """The location's fit if it has at least as many rows as coefficients, else the global one."""
    local = linear(train.where(F.col(location).isNotNull()), xs, y, [location]).where(F.col("n") >= len(xs) + 1)
    got = apply_linear(rows, local, xs, [location], "__local")
    return apply_linear(got, linear(train, xs, y), xs, None, "__all").withColumn(out, F.coalesce("__local", "__all")).drop("__local", "__all")


def contributions(rows: DataFrame, fits: DataFrame, key: str, xs: list[str]) -> DataFrame:
    """``key, base, contribution_<x>..., prediction``: each feature's share in a linear prediction."""
    got = rows.crossJoin(F.broadcast(fits.select(F.col("coef").alias("__coef"))))
    parts = [(F.col("__coef")[i + 1] * F.col(x)).alias(f"contribution_{x}") for i, x in enumerate(xs)]
    total = F.col("__coef")[0]
    for i, x in enumerate(xs):
        total = total + F.col("__coef")[i + 1] * F.col(x)
    return got.select(key, F.col("__coef")[0].alias("base"), *parts, total.alias("prediction"))


def vif(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix, from one row of sums."""
    import numpy as np

    r = gram(df, [F.col(x).cast("double") for x in xs], F.lit(0.0)).first()
    k = len(xs)
    if r is None or not r["n"]:
        return {}
    m = np.array([r[f"g0_{i}"] for i in range(1, k + 1)]) / r["n"]
    c = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(1, k + 1)] for i in range(1, k + 1)]) / r["n"] - np.outer(m, m)
    sd = np.sqrt(np.diag(c))
    return dict(zip(xs, np.diag(np.linalg.pinv(c / np.outer(sd, sd))).tolist(), strict=True))


def recursive_drop(df: DataFrame, xs: list[str], y: str, least_t: float = 2.0, most_vif: float = 10.0) -> list[str]:
    """Drops the weakest variable (|t| under ``least_t``), then the most inflated one, until none is left to drop.

    Each round is one row of sums; the data are only aggregated, never collected.
    """
    kept = list(xs)
    while kept:
        t = linear(df, kept, y).first()["t"][1:]
        i = min(range(len(kept)), key=lambda i: abs(t[i]))
        if abs(t[i]) < least_t:
            kept.pop(i)
            continue
        v = vif(df, kept)
        worst = max(v, key=v.get)
        if v[worst] <= most_vif:
            break
        kept.remove(worst)
    return kept


def row_mean(cols: list[Column]) -> Column:
    known = F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def row_median(cols: list[Column]) -> Column:
    v = [F.when(~F.isnan(c.cast("double")), c.cast("double")) for c in cols]
    total = F.lit(0.0)
    for x, w in zip(v, _middle(v), strict=True):
        total = total + F.when(w > 0, w * x).otherwise(0.0)
    return F.when(F.coalesce(*v).isNotNull(), total)


def _middle(v: list[Column]) -> list[Column]:
    """Weights of a row's middle values. Each value's place is counted by comparisons, which stay in generated code."""
    n = sum((c.isNotNull().cast("int") for c in v), F.lit(0))
    out = []
    for i, c in enumerate(v):
        place = F.lit(1)
        for j, o in enumerate(v):
            if i != j:
                place = place + F.coalesce(((o < c) | (o == c) if j < i else o < c).cast("int"), F.lit(0))
        half = lambda k: (place == k).cast("double")  # noqa: E731, B023
        out.append(F.when(c.isNotNull(), (half(F.floor((n + 1) / 2)) + half(F.floor(n / 2) + 1)) / 2).otherwise(0.0))
    return out


def median_weights(cols: list[str]) -> list[Column]:
    """Each member's weight in a row's median: 1 for the middle one, or a half for the two (ties: the first listed)."""
    return [w.alias(f"weight_{c}") for c, w in zip(cols, _middle([F.col(c).cast("double") for c in cols]), strict=True)]


def best_by_location(train: DataFrame, truth: str, members: list[str], location: str) -> DataFrame:
    """``location, member, mape``: the member with the smallest mean absolute percentage error in each location."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).cast("double").alias("p")) for m in members])).alias("x")
    e = train.where((F.col(truth) > 0) & F.col(location).isNotNull()).select(location, truth, long).where("x.p is not null")
    mape = e.groupBy(location, "x.member").agg(F.avg(F.abs(F.col("x.p") - F.col(truth)) / F.col(truth)).alias("mape"))
    return mape.groupBy(location).agg(F.min(F.struct("mape", "member")).alias("b")).select(location, "b.member", "b.mape")


def paint(rows: DataFrame, best: DataFrame, members: list[str], location: str, fallback: Column, out: str = "prediction") -> DataFrame:
    """Each row's prediction by its location's best member."""
    got = rows.join(best.select(location, "member"), location, "left")
    pick = F.coalesce(*[F.when(F.col("member") == m, F.col(m)) for m in members], fallback)
    return got.withColumn(out, pick).drop("member")


def backward_ensemble(df: DataFrame, truth: str, members: list[str]) -> list[str]:
    """Members whose median has the smallest error, dropping the individually worst one round by round.

    All rounds' errors are columns of one aggregation: the order of dropping depends on the single errors only.
    """
    err = lambda c: F.avg(F.abs(c - F.col(truth)) / F.col(truth))
    ok = df.where(F.col(truth) > 0)
    single = ok.agg(*[err(F.col(m)).alias(m) for m in members]).first()
    ranked = sorted(members, key=lambda m: (single[m] is None, single[m]))
    sets = [ranked[:k] for k in range(len(ranked), 0, -1)]
    got = ok.agg(*[err(row_median([F.col(m) for m in s])).alias(f"s{i}") for i, s in enumerate(sets)]).first()
    return min(enumerate(sets), key=lambda x: (got[f"s{x[0]}"] is None, got[f"s{x[0]}"], x[0]))[1]


def ratio_proxy(df: DataFrame, field: str, proxy: str, locations: list[str], out: str) -> DataFrame:
    """Fills ``field`` by proxy times the median ratio of the first location that has one (ratios trimmed to their 1st to
    99th percentile), else of all rows; ``inferred_<field>`` tells the filled rows."""
    r = df.where((F.col(field) > 0) & (F.col(proxy) > 0)).withColumn("__r", F.col(field) / F.col(proxy))
    q = r.agg(F.percentile("__r", [0.01, 0.99]).alias("q"))
    r = r.crossJoin(F.broadcast(q)).where((F.col("__r") >= F.col("q")[0]) & (F.col("__r") <= F.col("q")[1]))
    got = df
    for i, loc in enumerate(locations):
        got = got.join(r.where(F.col(loc).isNotNull()).groupBy(loc).agg(F.median("__r").alias(f"__m{i}")), loc, "left")
    got = got.crossJoin(F.broadcast(r.agg(F.median("__r").alias("__all"))))
    miss = F.col(field).isNull() & F.col(proxy).isNotNull()
    guess = F.rint(F.col(proxy) * F.coalesce(*[F.col(f"__m{i}") for i in range(len(locations))], F.col("__all")))
    return got.withColumns({out: F.when(miss, guess).otherwise(F.col(field)), f"inferred_{field}": miss}).drop("__all", *[f"__m{i}" for i in range(len(locations))])


def boosted(train: DataFrame, rows: DataFrame, xs: list[str], y: str, out: str = "prediction", rounds: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Gradient-boosted trees over numeric features; rows with null features get no prediction."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    prep = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip")
    model = GBTRegressor(featuresCol="__x", labelCol=y, predictionCol=out, maxIter=rounds, maxDepth=depth, seed=seed).fit(prep.transform(train.where(F.col(y).isNotNull())))
    return model.transform(prep.transform(rows)).drop("__x")


def forest(train: DataFrame, rows: DataFrame, xs: list[str], y: str, out: str = "prediction", trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """A random forest over numeric features; rows with null features get no prediction."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    prep = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip")
    model = RandomForestRegressor(featuresCol="__x", labelCol=y, predictionCol=out, numTrees=trees, maxDepth=depth, seed=seed).fit(prep.transform(train.where(F.col(y).isNotNull())))
    return model.transform(prep.transform(rows)).drop("__x")


def trend(df: DataFrame, by: list[str], at: str, value: str, ahead: int) -> DataFrame:
    """``by, slope, intercept, projected``: a straight line through each group's series, ``ahead`` steps after its last one."""
    f = linear(df, [at], value, by)
    last = df.groupBy(*by).agg(F.max(at).alias("__last"))
    j = null_safe_join(f, last, by)
    return j.select(*by, F.col("coef")[1].alias("slope"), F.col("coef")[0].alias("intercept"), (F.col("coef")[0] + F.col("coef")[1] * (F.col("__last") + ahead)).alias("projected"))


def elastic_net(df: DataFrame, xs: list[str], y: str, strength: float = 0.1, mix: float = 0.5) -> DataFrame:
    """``variable, coef`` of a penalised linear fit over standardised features (rows with nulls left out)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    prep = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip").transform(df.where(F.col(y).isNotNull()).select(y, *xs))
    model = LinearRegression(featuresCol="__x", labelCol=y, regParam=strength, elasticNetParam=mix, standardization=True).fit(prep)
    return df.sparkSession.createDataFrame([(x, float(c)) for x, c in zip(xs, model.coefficients, strict=True)], "variable string, coef double")


def cross_validated(df: DataFrame, key: str, xs: list[str], y: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``fold, n, mse, r2`` of linear fits to the other folds, folds by the key's hash.

    The sums of all folds come from one pass; a fold's training sums are the total less its own, so nothing is fitted on
    rows, and one row per fold comes to the driver.
    """
    import pandas as pd

    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
    d = df.withColumn("__fold", fold)
    means = df.agg(*[F.avg(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(xs)]).first()
    shifted = [F.col(x).cast("double") - F.lit(means[i] or 0.0) for i, x in enumerate(xs)]
    g = pd.DataFrame([r.asDict() for r in gram(d, shifted, F.col(y).cast("double"), ["__fold"]).collect()])
    if g.empty:
        return df.sparkSession.createDataFrame([], "fold int, n long, mse double, r2 double")
    rest = g.copy()
    for c in g.columns:
        if c != "__fold":
            rest[c] = g[c].sum() - g[c]
    fits = _solve(rest, ["__fold"], len(xs))
    value = F.lit(None).cast("double")
    for f, c in zip(fits["__fold"], fits["coef"], strict=True):
        e = F.lit(c[0])
        for a, s in zip(c[1:], shifted, strict=True):
            e = e + F.lit(a) * s
        value = F.when(F.col("__fold") == int(f), e).otherwise(value)
    p = d.withColumn("__p", value).where(F.col("__p").isNotNull() & F.col(y).isNotNull())
    s = p.groupBy(F.col("__fold").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("__p") - F.col(y), 2)).alias("mse"), F.var_pop(y).alias("v"))
    return s.select("fold", "n", "mse", (1 - F.try_divide("mse", "v")).alias("r2"))


def random_baseline(train: DataFrame, rows: DataFrame, key: str, y: str, normal: bool = False, seed: int = 1, out: str = "prediction") -> DataFrame:
    """Predictions without information: uniform between the training extremes, or normal with its mean and deviation; by the key's hash."""
    one = train.agg(F.min(y).alias("__a"), F.max(y).alias("__z"), F.avg(y).alias("__m"), F.stddev_samp(y).alias("__s"))
    u = lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed + k)), F.lit(1_000_003)) + 1) / 1_000_004.0
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.pi() * u(1))
    return rows.crossJoin(F.broadcast(one)).withColumn(out, F.col("__m") + z * F.col("__s") if normal else F.col("__a") + u(0) * (F.col("__z") - F.col("__a"))).drop("__a", "__z", "__m", "__s")


def chased(prediction: Column, price: Column, key: Column, spread: float = 0.01, seed: int = 1) -> Column:
    """The price within ``spread`` where there is one, else the prediction."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_002.0
    return F.when(price > 0, price * (1 + spread * (2 * u - 1))).otherwise(prediction)
