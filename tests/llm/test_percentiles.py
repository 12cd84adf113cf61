import math
import random

from plumbline.llm import percentiles as pct

BPS = [1, 500, 5000, 9500, 10000]


def brute(values, bp):
    v = sorted(values)
    return v[max(1, -(-len(v) * bp // 10000)) - 1]


def test_exact_with_ties_nulls_and_a_hot_group(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.choice([None, float("nan"), -1.5, 0.0, -0.0, float("inf"), rnd.randrange(50) / 4, 7.0]), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, x double, n int")
    got = {r["g"]: r for r in pct.percentiles(pct.value_counts(df, ["g"], "x"), ["g"], BPS).collect()}
    for g in {d[0] for d in data}:
        vals = [x for k, x, _ in data if k == g and x is not None and not math.isnan(x)]
        assert got[g]["n"] == len(vals)
        assert [got[g][f"p{b}"] for b in BPS] == [brute(vals, b) for b in BPS]


def test_partial_states_combine_within_the_stated_error(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("ab"), rnd.randrange(12), math.exp(rnd.gauss(11, 1.5)) * rnd.choice([1, 1, 1, -1])) for _ in range(5000)]
    df = spark.createDataFrame(data, "g string, day int, x double")
    days = pct.value_counts(df, ["g", "day"], "x", 0.01)
    whole = pct.percentiles(pct.combine(days, ["g"]), ["g"], BPS)
    at_once = pct.percentiles(pct.value_counts(df, ["g"], "x", 0.01), ["g"], BPS)
    assert sorted(whole.collect()) == sorted(at_once.collect())
    for r in whole.collect():
        vals = [x for g, _, x in data if g == r["g"]]
        for b in BPS:
            exact = brute(vals, b)
            assert abs(r[f"p{b}"] - exact) <= 0.01 * abs(exact) * (1 + 1e-9)


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert pct.percentiles(pct.value_counts(df, ["g"], "x"), ["g"], BPS).count() == 0
