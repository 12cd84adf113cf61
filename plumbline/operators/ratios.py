"""Ratio and equity statistics, trimming, regression measures, correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import bins, groups, quantiles
from plumbline.operators.skew import SMALL_ROWS, null_safe_join
from plumbline.session import cut, kept


def with_ratio(df: DataFrame, prediction: str, truth: str, out: str = "ratio") -> DataFrame:
    """Rows with both values, a positive truth, and their ratio."""
    return df.where(F.col(prediction).isNotNull() & ~F.isnan(F.col(prediction).cast("double")) & (F.col(truth) > 0) & ~F.isnan(F.col(truth).cast("double"))).withColumn(out, F.col(prediction) / F.col(truth))


def ratio_study(df: DataFrame, by: list[str], prediction: str, truth: str, exact: bool = False) -> DataFrame:
    """``by, n, median_ratio, mean_ratio, cod, prd, prb_intercept, prb_slope`` per group.

    PRD is the mean ratio over the ratio of sums; PRB regresses the relative deviation from the median ratio on log2
    of half the market proxy (prediction over median, plus truth). The median is an aggregate joined back, so the
    second pass is partially aggregated as well. With ``exact`` the medians are worked out at once, without a group's values
    in one task; ``df`` is read several times then and should be at hand (``session.kept``).
    """
    r = with_ratio(df, prediction, truth)
    if exact:
        med = cut(quantiles.median(r, by, "ratio", "__m"))
        med = F.broadcast(med) if med.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else med
    else:
        med = r.groupBy(*by).agg(F.median("ratio").alias("__m"))
    j = null_safe_join(r, med, by) if by else r.crossJoin(F.broadcast(med))
    y = F.try_divide(F.col("ratio") - F.col("__m"), F.col("__m"))
    proxy = (F.try_divide(F.col(prediction), F.col("__m")) + F.col(truth)) / 2
    x = F.when(proxy > 0, F.log2(proxy))
    # regr_slope raises where x does not vary, so the sums are used
    j = j.withColumns({"__y": F.when(x.isNotNull(), y), "__x": F.when(y.isNotNull(), x), "__d": F.abs(F.col("ratio") - F.col("__m"))})
    s = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("__m").alias("median_ratio"), F.avg("ratio").alias("mean_ratio"), F.avg("__d").alias("d"), F.sum(prediction).alias("sp"), F.sum(truth).alias("st"),
        F.avg("__x").alias("ax"), F.avg("__y").alias("ay"), F.covar_pop("__x", "__y").alias("cxy"), F.var_pop("__x").alias("vx"),
    )
    slope = F.try_divide("cxy", "vx")
    return s.select(*by, "n", "median_ratio", "mean_ratio", (100 * F.try_divide("d", "median_ratio")).alias("cod"), F.try_divide("mean_ratio", F.try_divide("sp", "st")).alias("prd"), (F.col("ay") - slope * F.col("ax")).alias("prb_intercept"), slope.alias("prb_slope"))


def trim(df: DataFrame, field: str, by: list[str] | None = None, factor: float = 1.5, most: float = 0.05) -> DataFrame:
    """Rows within ``factor`` interquartile ranges of the quartiles; where more than ``most`` of a group would go, the
    symmetric quantiles that take off ``most`` in all are the bounds instead. ``df`` is read several times, so it should be
    at hand (``session.kept``)."""
    by = by or []
    q = cut(quantiles.exact(df, by, field, [0.25, 0.75, most / 2, 1 - most / 2]).drop("n"))
    spread = F.col("q")[1] - F.col("q")[0]
    b = q.select(*by, (F.col("q")[0] - factor * spread).alias("__lo"), (F.col("q")[1] + factor * spread).alias("__hi"), F.col("q")[2].alias("__qlo"), F.col("q")[3].alias("__qhi"))
    j = null_safe_join(df, b, by) if by else df.crossJoin(F.broadcast(b))
    out = F.avg(((F.col(field) < F.col("__lo")) | (F.col(field) > F.col("__hi"))).cast("double"))
    share = cut(j.groupBy(*by).agg(out.alias("__out")))
    j = null_safe_join(j, share, by) if by else j.crossJoin(F.broadcast(share))
    lo, hi = F.when(F.col("__out") > most, F.col("__qlo")).otherwise(F.col("__lo")), F.when(F.col("__out") > most, F.col("__qhi")).otherwise(F.col("__hi"))
    return j.where((F.col(field) >= lo) & (F.col(field) <= hi)).drop("__lo", "__hi", "__qlo", "__qhi", "__out")


def pooled(df: DataFrame, field: str, least: int, other: str = "other") -> DataFrame:
    """``field`` with values of fewer than ``least`` rows pooled (null counts as a value and is pooled)."""
    n = df.groupBy(field).agg(F.count(F.lit(1)).alias("__n"))
    return null_safe_join(df, n, [field]).withColumn(field, F.when((F.col("__n") >= least) & F.col(field).isNotNull(), F.col(field).cast("string")).otherwise(other)).drop("__n")


def spread_of(df: DataFrame, field: str) -> DataFrame:
    """One row: number, least, 5th, 25th, 50th, 75th, 95th percentile and largest value."""
    q = df.where(F.col(field).isNotNull()).agg(F.count(field).alias("n"), F.percentile(field, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]).alias("q"))
    return q.select("n", *[F.col("q")[i].alias(f"{field}_{s}") for i, s in enumerate(("min", "p05", "p25", "median", "p75", "p95", "max"))])


def vertical_equity(df: DataFrame, by: list[str], prediction: str, truth: str) -> DataFrame:
    """``by, n, groups, vei`` : the difference of the median ratios of the top and bottom value groups, in percent of the
    overall median. Values are ranked by half the truth plus half the prediction over the median ratio, into 2, 4 or 10
    groups for up to 50, 500 or more rows; groups under 20 rows have none."""
    r = with_ratio(df, prediction, truth)
    med = r.groupBy(*by).agg(F.median("ratio").alias("__m"), F.count(F.lit(1)).alias("n"))
    j = null_safe_join(r, med, by).withColumn("__v", 0.5 * F.col(truth) + 0.5 * F.col(prediction) / F.col("__m"))
    j = j.withColumn("groups", F.when(F.col("n") < 20, None).when(F.col("n") <= 50, 2).when(F.col("n") <= 500, 4).otherwise(10)).where("groups is not null")
    edges = j.groupBy(*by).agg(F.percentile("__v", [0.1, 0.25, 0.5, 0.75, 0.9]).alias("__e"))
    j = null_safe_join(j, edges, by)
    low = F.when(F.col("groups") == 2, F.col("__e")[2]).when(F.col("groups") == 4, F.col("__e")[1]).otherwise(F.col("__e")[0])
    high = F.when(F.col("groups") == 2, F.col("__e")[2]).when(F.col("groups") == 4, F.col("__e")[3]).otherwise(F.col("__e")[4])
    s = j.groupBy(*by).agg(F.first("n").alias("n"), F.first("groups").alias("groups"), F.first("__m").alias("m"), F.median(F.when(F.col("__v") <= low, F.col("ratio"))).alias("bottom"), F.median(F.when(F.col("__v") > high, F.col("ratio"))).alias("top"))
    return s.select(*by, "n", "groups", (100 * F.try_divide(F.col("top") - F.col("bottom"), F.col("m"))).alias("vei"))


def quantile_table(df: DataFrame, prediction: str, truth: str, n: int) -> DataFrame:
    """Ratio statistics by quantile of the truth."""
    return ratio_study(bins.quantile_bins(with_ratio(df, prediction, truth), truth, n, "bin"), ["bin"], prediction, truth)


def fit_metrics(df: DataFrame, by: list[str], prediction: str, truth: str, variables: int = 1) -> DataFrame:
    """``by, n, mse, rmse, mape, r2, adj_r2, slope`` of a prediction; r2 is 1 - SSE/SST."""
    r = with_ratio(df, prediction, truth)
    e = F.col(prediction) - F.col(truth)
    s = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e) / F.col(truth)).alias("mape"), F.var_pop(truth).alias("vt"), F.covar_pop(prediction, truth).alias("c"), F.var_pop(prediction).alias("vp")
    )
    r2 = 1 - F.try_divide("mse", "vt")
    return s.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mape", r2.alias("r2"), (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - 1 - variables)).alias("adj_r2"), F.try_divide("c", "vp").alias("slope"))


def univariate(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``variable, n, r2, adj_r2, slope, intercept`` of one-variable regressions; all in one pass over sums."""
    cells = []
    for x in xs:
        ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
        a, b = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
        cells += [F.count(a).alias(f"n_{x}"), F.avg(a).alias(f"ax_{x}"), F.avg(b).alias(f"ay_{x}"), F.covar_pop(a, b).alias(f"c_{x}"), F.var_pop(a).alias(f"vx_{x}"), F.var_pop(b).alias(f"vy_{x}")]
    one = df.agg(*cells)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("variable"), *[F.col(f"{k}_{x}").alias(k) for k in ("n", "ax", "ay", "c", "vx", "vy")]) for x in xs])).alias("r")
    r2 = F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    slope = F.try_divide("c", "vx")
    return one.select(rows).select("r.*").select("variable", "n", r2.alias("r2"), (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - 2)).alias("adj_r2"), slope.alias("slope"), (F.col("ay") - slope * F.col("ax")).alias("intercept"))


def correlations(df: DataFrame, fields: list[str]) -> DataFrame:
    """``a, b, corr`` for each pair of fields (rows where both are known); null where one does not vary. One pass."""
    num = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in fields}
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    cells = []
    for i, (a, b) in enumerate(pairs):
        both = num[a].isNotNull() & num[b].isNotNull()
        x, y = F.when(both, num[a]), F.when(both, num[b])
        cells += [F.covar_pop(x, y).alias(f"c{i}"), F.var_pop(x).alias(f"x{i}"), F.var_pop(y).alias(f"y{i}")]
    one = df.agg(*cells)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"x{i}") * F.col(f"y{i}"))).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")
    return one.select(rows).select("r.*")


def choose_by_correlation(corr: DataFrame, target: str, threshold: float = 0.1) -> list[str]:
    """Fields kept by correlation strength: of all fields, those whose strength with the target times its clarity (how far
    it exceeds their mean correlation with the others) reaches ``threshold`` of the best. Works on the k x k result."""
    m: dict[str, dict[str, float]] = {}
    for r in corr.collect():  # one row per pair of fields
        m.setdefault(r["a"], {})[r["b"]] = m.setdefault(r["b"], {})[r["a"]] = abs(r["corr"] or 0.0)
    kept = [f for f in m if f != target]
    while True:
        score = {f: m[f][target] * max(0.0, 1 - sum(m[f][g] for g in kept if g != f) / max(1, len(kept) - 1)) ** 2 for f in kept}
        worst = min(kept, key=lambda f: (score[f], f), default=None)
        if worst is None or score[worst] >= threshold * max(score.values()):
            return sorted(kept, key=lambda f: (-m[f][target], f))
        kept.remove(worst)


#: Shares of the weights 0, 1, 2, ... and less of a Poisson(1) distribution, as far as doubles tell them from 1.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]


def poisson_weights(rng, rows: int, columns: int):
    """Poisson(1) weights, exact to the resolution of doubles: 16 random bits are looked up, and the few cells in which the
    distribution steps are told apart by further bits."""
    import numpy as np

    cells = np.arange(65536) / 65536
    low, high = np.searchsorted(_POISSON, cells, "right"), np.searchsorted(_POISSON, cells + 1 / 65536, "left")
    table, steps = low.astype(np.int8), low != high
    u = rng.integers(0, 65536, (rows, columns), np.uint16)
    w = table[u]
    i, j = np.nonzero(steps[u])
    w[i, j] = np.searchsorted(_POISSON, (u[i, j] + rng.random(len(i))) / 65536, "right")
    return w


def bootstrap(df: DataFrame, prediction: str, truth: str, replicates: int = 200, seed: int = 777, confidence: float = 0.95, few: int = 100_000) -> DataFrame:
    """Percentile intervals of mean and median ratio: every row gets a Poisson(1) weight per replicate; ``statistic, low,
    high``. Random, but the same for a seed and the same partitions.

    A batch's weights are drawn and summed at once. All replicates' medians lie near the median, so only values between
    two quantiles about it (of more than ``few`` rows) are kept with their weights and sorted; of the others, the weights
    below are summed. If a replicate's median lies outside, the quantiles are widened, in the end to all values.
    """
    with kept(with_ratio(df, prediction, truth).select(F.col("ratio").cast("double").alias("ratio"))) as r:
        sides = [2.0**-i for i in range(2, 13)]
        q = r.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ratio", [0.5 + s * e for e in sides for s in (-1, 1)], 20_000).alias("q")).first()
        # six deviations of the rank of a replicate's median, and the sketch's error
        fit = [i for i, e in enumerate(sides) if e >= 3 / max(1, q["n"]) ** 0.5 + 1e-4] if q["n"] > few else []
        i = max(fit, default=-1)
        while True:
            reps, held = _replicates(r, (q["q"][2 * i], q["q"][2 * i + 1]) if i >= 0 else None, replicates, seed)
            if held or i < 0:
                break
            i -= 2
    tail = (1 - confidence) / 2
    return reps.agg(*[F.percentile(c, [tail, 1 - tail]).alias(c) for c in ("mean", "median")]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high")) for c in ("mean", "median")])).alias("x")).select("x.*")


def _replicates(r: DataFrame, between: tuple[float, float] | None, replicates: int, seed: int) -> tuple[DataFrame, bool]:
    """``rep, mean, median``, one row per replicate with any weight, and whether all medians lie in ``between`` (None: all values)."""

    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, step = np.zeros((3, replicates)), max(1, 1_000_000 // replicates)
        for pdf in batches:
            for at in range(0, len(pdf), step):
                v = pdf["ratio"].to_numpy()[at : at + step]
                w = poisson_weights(rng, len(v), replicates)
                low, near = (np.zeros(len(v), bool), np.ones(len(v), bool)) if between is None else (v < between[0], (v >= between[0]) & (v <= between[1]))
                sums += np.stack([np.ones(len(v)), low, v]) @ w.astype(np.float64)
                values, place = np.unique(v[near], return_inverse=True)
                if len(values):
                    added = np.zeros((len(values), replicates), np.int32)
                    np.add.at(added, place, w[near])
                    yield pd.DataFrame({"kind": 3, "ratio": values, "w": list(added.astype(np.float64))})
        yield pd.DataFrame({"kind": range(3), "ratio": None, "w": list(sums)}).astype({"ratio": float})

    # drawn once: the sums and the values must have the same weights
    drawn = cut(r.mapInPandas(run, "kind int, ratio double, w array<double>"))
    long = drawn.select("kind", "ratio", F.posexplode("w").alias("rep", "w")).where("w > 0 or kind < 3")
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("w")))
    sums = long.where("kind < 3").groupBy("rep").agg(part(0).alias("n"), part(1).alias("below"), part(2).alias("total")).where("n > 0")
    counts = long.where("kind = 3").groupBy("rep", "ratio").agg(F.sum("w").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("rep").orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    j = sums.join(counts.withColumn("upto", upto), "rep", "left").withColumn("reached", F.col("below") + F.col("upto"))
    one = j.groupBy("rep").agg(
        F.first(F.col("total") / F.col("n")).alias("mean"), F.min(F.when(F.col("reached") > low, F.col("ratio"))).alias("x"), F.min(F.when(F.col("reached") > high, F.col("ratio"))).alias("y"), F.first(F.col("below") <= low).alias("ok")
    )
    one = cut(one.select("rep", "mean", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(0.5 * F.col("x") + 0.5 * F.col("y")).alias("median"), (F.col("ok") & F.col("y").isNotNull()).alias("ok")))
    return one.drop("ok"), one.where("not ok").isEmpty()


def utility(metrics: Column | None = None, *, ratio: Column, cod: Column, chd: Column) -> Column:
    """A penalty for a prediction set: distance of the median ratio from 1, dispersion, and too little dispersion within clusters."""
    far = F.abs(ratio - 1) * 1000
    chase = F.when(cod > 0, 7.5 * chd / cod).otherwise(0.0)
    return F.when(ratio < 1.05, far).otherwise(2 * far) + 1.5 * cod + chd + chase


def chd_distribution(df: DataFrame, cluster: str, field: str) -> DataFrame:
    """The spread of the clusters' coefficients of dispersion (clusters of two or more rows)."""
    return spread_of(groups.deviation(df.where(F.col(cluster).isNotNull()), [cluster], field).where("n > 1").select(F.col("cod").alias("chd")), "chd")


def scrutiny(df: DataFrame, cluster: str, field: str) -> DataFrame:
    """``df`` with its cluster's ``n, median, std``, ``ratio`` to the median, and ``flag`` for values outside two standard
    deviations, at least four times the median, or at most 0.35 of it and over one deviation below."""
    j = groups.with_aggregates(df, [cluster], n=F.count(field), median=F.median(field), std=F.stddev_samp(field))
    ratio, z = F.try_divide(F.col(field), F.col("median")), F.try_divide(F.col(field) - F.col("median"), F.col("std"))
    flag = F.coalesce((F.abs(z) > 2) | (ratio >= 4) | ((ratio <= 0.35) & (z < -1)), F.lit(False))
    return j.withColumns({"ratio": ratio, "flag": flag})


def two_humps(df: DataFrame, cluster: str, field: str, bins: int = 200, least: int = 8) -> DataFrame:
    """``cluster, n, separation, gain, bimodal``: whether two normal curves describe the logarithm of ``field`` better than one.

    A cluster is reduced to a histogram of at most ``bins`` cells first, so its size doesn't matter; the two curves are
    fitted to the cells by expectation and maximisation. Bimodal: at least ``least`` rows, a gain of 10 in the Bayesian
    criterion, means more than 2 pooled deviations apart, and at least 15 % of the rows in each.
    """
    v = df.where((F.col(field) > 0) & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.ln(field).alias("x"))
    lim = v.groupBy("c").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    cell = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("x") - F.col("a"), F.col("z") - F.col("a")) * bins))
    h = v.join(lim, "c").groupBy("c", F.coalesce(cell, F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("w"), F.avg("x").alias("x"))
    rows = h.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("h"))  # at most ``bins`` cells
    kind = dict(df.dtypes)[cluster]

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for c, cells in pdf.itertuples(index=False):
                x, w = np.array([p["x"] for p in cells]), np.array([float(p["w"]) for p in cells])
                n = w.sum()
                m, s = (w * x).sum() / n, 0.0
                s = max(np.sqrt((w * (x - m) ** 2).sum() / n), 1e-9)
                if n < least or len(x) < 2:
                    out.append((c, int(n), None, None, False))
                    continue
                den = lambda m, s: np.exp(-((x - m) ** 2) / (2 * s * s)) / (s * 2.5066282746310002)
                one = (w * np.log(np.maximum(den(m, s), 1e-300))).sum()
                m1, m2, s1, s2, p = m - s, m + s, s, s, 0.5
                for _ in range(200):
                    a, b = p * den(m1, s1), (1 - p) * den(m2, s2)
                    r = a / np.maximum(a + b, 1e-300)
                    wa, wb = w * r, w * (1 - r)
                    if min(wa.sum(), wb.sum()) < 1e-6:
                        break
                    p, m1, m2 = wa.sum() / n, (wa * x).sum() / wa.sum(), (wb * x).sum() / wb.sum()
                    s1, s2 = max(np.sqrt((wa * (x - m1) ** 2).sum() / wa.sum()), s / 50), max(np.sqrt((wb * (x - m2) ** 2).sum() / wb.sum()), s / 50)
                two = (w * np.log(np.maximum(p * den(m1, s1) + (1 - p) * den(m2, s2), 1e-300))).sum()
                gain = (2 * np.log(n) - 2 * one) - (5 * np.log(n) - 2 * two)
                d = abs(m1 - m2) / np.sqrt((s1**2 + s2**2) / 2)
                out.append((c, int(n), float(d), float(gain), bool(gain >= 10 and d > 2 and 0.15 <= p <= 0.85)))
            yield pd.DataFrame(out, columns=["c", "n", "separation", "gain", "bimodal"])

    return rows.mapInPandas(run, f"c {kind}, n long, separation double, gain double, bimodal boolean").withColumnRenamed("c", cluster)
