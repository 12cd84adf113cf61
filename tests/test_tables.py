import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import asof, bins, dedupe, frames, groups, series
from tests.conftest import rows


def day(s):
    return dt.datetime.fromisoformat(s)


def test_keep_first_and_drop_repeated(spark):
    df = spark.createDataFrame([("a", 1, 1990), ("a", 2, 1996), ("b", 3, 1993), ("c", 4, None), ("c", 5, 1999), (None, 6, 1), (None, 7, 2)], "key string, price long, year int")
    assert rows(dedupe.keep_first(df, ["key"], [["year", "desc"], "price"])) == [(None, 7, 2), ("a", 2, 1996), ("b", 3, 1993), ("c", 5, 1999)]
    assert rows(dedupe.drop_repeated(df, ["key"])) == [("b", 3, 1993)]


def test_collapse(spark):
    df = spark.createDataFrame([("10", 1, "x", 1.0, 2), ("10", 2, None, 2.6, 3), ("11", 1, "z", None, 1), (None, 1, "n", 4.0, 4), (None, 2, "m", 5.0, 5)], "key string, num long, kind string, stories double, beds long")
    agg = {"stories": {"field": "stories", "op": "mean"}, "beds": {"field": "beds", "op": "sum"}, "first_kind": {"field": "kind", "op": "first", "sort_by": [["num", "desc"]]}, "n": {"field": "num", "op": "count"}}
    got = rows(dedupe.collapse(df, ["key"], ["num"], agg))
    assert got == [(None, 1, "n", 4.5, 9, "m", 2), ("10", 1, "x", 1.8, 5, "x", 2), ("11", 1, "z", None, 1, "z", 1)]


def test_merge_reconciles_even_one_conflict(spark):
    a = spark.createDataFrame([("1", "apple"), ("2", None), ("3", None)], "key string, fruit string")
    b = spark.createDataFrame([("1", "pear"), ("2", "plum")], "key string, fruit string")
    c = spark.createDataFrame([("3", "fig"), ("2", "kiwi"), (None, "x")], "key string, fruit string")
    t = [("a", a), ("b", b), ("c", c)]
    assert rows(frames.merge(t, [{"id": "a"}, {"id": "b"}])) == [("1", "apple"), ("2", "plum"), ("3", None)]
    assert rows(frames.merge(t, [{"id": "a"}, {"id": "b"}, {"id": "c"}])) == [("1", "apple"), ("2", "plum"), ("3", "fig")]
    assert rows(frames.merge(t, [{"id": "a"}, {"id": "b"}, {"id": "c"}], {"fruit": ["c", "b"]})) == [("1", "apple"), ("2", "kiwi"), ("3", "fig")]
    assert frames.merge(t, [{"id": "a"}, {"id": "c", "how": "append"}]).count() == 5
    other = b.withColumnRenamed("key", "id")
    assert rows(frames.merge([("a", a), ("o", other)], [{"id": "a"}, {"id": "o", "left_on": "key", "right_on": "id", "how": "outer"}])) == [("1", "apple"), ("2", "plum"), ("3", None)]


def test_keyed_updates(spark):
    a = spark.createDataFrame([("1", "apple", None), ("2", None, "red")], "key string, fruit string, color string")
    b = spark.createDataFrame([("2", "plum", None, 7), ("9", "x", "y", 8)], "key string, fruit string, color string, extra long")
    assert rows(frames.keyed_update(a, b, "key")) == [("1", "apple", None, None), ("2", "plum", "red", 7)]
    assert rows(frames.keyed_update(a, b, "key", overwrite=True)) == [("1", "apple", None, None), ("2", "plum", None, 7)]
    assert rows(frames.stomp(a, b, "key", right_wins=True)) == [("1", "apple", None, None), ("2", "plum", "red", 7)]
    with pytest.raises(ValueError):
        frames.lookup(a, b, "key", "key", ["fruit"])
    assert rows(frames.lookup(a, b, "key", "key", ["extra"])) == [("1", "apple", None, None), ("2", None, "red", 7)]
    assert rows(frames.fill_from(a, b, "key", "fruit").select("fruit")) == [("apple",), ("plum",)]


def test_pair(spark):
    u = spark.createDataFrame([("p", "res", 10), ("q", "com", 20)], "key string, model_group string, area long")
    s = spark.createDataFrame([("s1", "p", None, 5.0), ("s2", "q", 99, 6.0), ("s3", None, 1, 7.0)], "key_sale string, key string, area long, price double")
    pair = frames.ParcelSales(u, s)
    assert {(r["key_sale"], r["area"], r["model_group"]) for r in pair.hydrated().collect()} == {("s1", 10, "res"), ("s2", 99, "com"), ("s3", 1, None)}
    assert rows(pair.of_group("com").sales.select("key_sale")) == [("s2",)]
    assert pair.with_sales(s.where("price > 5").withColumn("x", F.lit(1)), may_drop=True).sales.count() == 2
    assert pair.limited_to(s.where("price > 6")).sales.count() == 1


def test_asof(spark):
    s = spark.createDataFrame([(1, "a", day("2020-01-01")), (2, "a", day("2020-06-01")), (3, "b", day("2020-01-01")), (4, None, day("2020-01-01"))], "id long, key string, at timestamp")
    p = spark.createDataFrame([("a", day("2020-01-31"), 1), ("a", day("2020-01-01"), 9), ("a", day("2020-03-01"), 3), ("b", day("2019-12-31"), 2), (None, day("2020-02-01"), 1)], "key string, date timestamp, num long")
    assert rows(asof.next_after(s, p, "key", "id", "at", "date", ["num"])) == [(1, 30, 1)]
    assert rows(asof.best_before(s, p, "key", "id", "at", "date", F.col("num"), ["num"])) == [(2, -152, 9), (3, -1, 2)]


def test_group_statistics(spark):
    df = spark.createDataFrame([("A", 100.0, "r"), ("A", 200.0, "r"), ("A", 300.0, "c"), ("B", 450.0, "c"), ("B", None, None), ("C", float("nan"), "x")], "hood string, v double, z string")
    got = {r["hood"]: r for r in groups.numeric_stats(df, ["hood"], "v", "v").collect()}
    assert (got["A"]["v_mean"], got["A"]["v_median"], got["A"]["v_count"], got["A"]["v_iqr"]) == (200.0, 200.0, 3, 100.0)
    assert (got["B"]["v_std"], got["B"]["v_count"], got["C"]["v_mean"], got["C"]["v_count"]) == (None, 1, None, 0)
    cat = {r["hood"]: r for r in groups.category_stats(df, ["hood"], "z", "z").collect()}
    assert cat["A"]["z_mode"] == "r" and cat["A"]["z_mode_frac"] == pytest.approx(2 / 3) and cat["A"]["z_entropy"] == pytest.approx(0.6365, abs=1e-4)
    dev = {r["hood"]: r["cod"] for r in groups.deviation(df.where("not isnan(v)"), ["hood"], "v").collect()}
    assert dev["A"] == pytest.approx(100 * (200 / 3) / 200)


def test_fills_and_sparse(spark):
    df = spark.createDataFrame([(1, "g", None), (2, "g", 4.0), (3, "g", 8.0), (4, None, None), (5, None, 3.0), (6, "h", None)], "id long, mg string, v double")
    assert [r["v"] for r in groups.fill_by_group(df, ["mg"], "v", "median").orderBy("id").collect()] == [6.0, 4.0, 8.0, 3.0, 3.0, None]
    assert [r["v"] for r in groups.fill_by_group(df, ["mg"], "v", "zero", F.col("id") < 3).orderBy("id").collect()] == [0.0, 4.0, 8.0, None, 3.0, None]
    u = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] + [(None,)], "z string")
    s = spark.createDataFrame([("a",)] * 3 + [("b",)] + [("d",)], "z string")
    cu, cs = groups.collapse_sparse(u, s, "z", 2, 2)
    assert rows(cu.distinct()) == [(None,), ("OTHER",), ("a",)] and rows(cs.distinct()) == [("OTHER",), ("a",)]
    one, _ = groups.collapse_sparse(u.where("z in ('a', 'b')"), s.where("z in ('a', 'b')"), "z", 2, 2)
    assert rows(one.distinct()) == [("a",), ("b",)]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, True, ""), (0.0, None, "x"), (float("nan"), False, None)], "a double, b boolean, c string")
    got = {r["field"]: tuple(r)[1:] for r in groups.profile(df).collect()}
    assert got == {"a": ("number", 3, 2, 1, 2), "b": ("boolean", 3, 2, 1, 2), "c": ("text", 3, 2, 1, 2)}


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    got = {r["v"]: r["q"] for r in bins.quantile_bins(df, "v", 5, "q").collect()}
    assert got == {None: None, **{float(i): (i + 1) // 2 for i in range(1, 11)}}
    x = df.select("v", bins.fixed_bins(F.col("v"), [1, 5, 8]).alias("b"), bins.slice_label(F.col("v"), 5).alias("s")).collect()
    assert {r["v"]: r["b"] for r in x} == {None: None, 1.0: 1, 2.0: 1, 3.0: 1, 4.0: 1, 5.0: 1, 6.0: 2, 7.0: 2, 8.0: 2, 9.0: None, 10.0: None}
    assert {r["v"]: r["s"] for r in x}[7.0] == "5 - 10"


def test_rank_share_and_clusters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", None), ("b", 5)], "g string, v long")
    assert sorted((r["g"], r["v"] or 0, r["p"]) for r in bins.rank_share(df, ["g"], "v", "p").collect() if r["v"]) == [("a", 1, 0.5), ("a", 1, 0.5), ("a", 3, 1.0), ("b", 5, 1.0)]
    many = spark.createDataFrame([(i, f"h{i % 2}", float(i), None if i % 2 else float(i % 7)) for i in range(200)] + [(900, "h9", 1.0, 1.0), (901, None, None, None)], "id long, hood string, size double, odd double")
    got = bins.refine_clusters(many, ["hood"], ["size", "odd"], 15, "c").collect()
    assert len(got) == 202 and len({r["c"] for r in got if r["hood"] == "h0"}) == 5 and {r["c"] for r in got if r["hood"] == "h9"} == {"h9"}


def test_series(spark):
    known = {1: 1.0, 3: 3.0, 6: 9.0}
    df = spark.createDataFrame([("g", i, known.get(i)) for i in range(0, 9)], "g string, i long, v double")
    assert [r["f"] for r in series.interpolate(df, ["g"], "i", "v", "f").orderBy("i").collect()] == [1, 1, 2, 3, 5, 7, 9, 9, 9]
    s = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([3, 6, 12, 0, 9])], "g string, i long, v double")
    want = [3.0]
    for i in range(1, 4):
        want.append((want[-1] + [3, 6, 12, 0, 9][i] + [3, 6, 12, 0, 9][i + 1]) / 3)
    assert [r["f"] for r in series.smooth(s, ["g"], "i", "v", "f").orderBy("i").collect()] == [*want, 9.0]
    assert [r["f"] for r in series.to_first(s, ["g"], "i", "v", "f").orderBy("i").collect()] == [1, 2, 4, 0, 3]
    prices = spark.createDataFrame([("g", m, p) for m, p in [("2020-01", 100.0)] * 3 + [("2020-04", 130.0)] * 3], "g string, month string, p double")
    idx = {r["month"]: (r["filled"], r["factor"]) for r in series.time_index(prices, ["g"], "month", "p", 3).collect()}
    assert idx["2020-02"][0] == pytest.approx(110) and idx["2020-01"][1] == pytest.approx(1.3) and idx["2020-04"] == (130.0, 1.0)
