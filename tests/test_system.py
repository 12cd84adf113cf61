import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.skew import null_safe_join, salted_join
from plumbline.plans import settings
from plumbline.sources import readers, synthetic, writers
from plumbline.streaming import windows
from tests.conftest import SMALL, rows


def test_settings_document():
    template = {"+list": [1, 2], "a": {"x": 1, "y": [1]}, "keep": 3}
    local = {"list": [2, 4], "a": {"x": 5, "y": [9]}, "__note": "gone", "v": {"deep": {"w": "$$a.x"}, "again": "$$v.deep"}, "!keep": {"new": 1}}
    got = settings.load(local, template)
    assert got == {"list": [1, 2, 4], "a": {"x": 5, "y": [9]}, "v": {"deep": {"w": 5}, "again": {"w": 5}}, "keep": {"new": 1}}
    for bad in ({"a": "$$nope"}, {"a": "$$b", "b": "$$a"}):
        with pytest.raises(ValueError):
            settings.load(bad)


def test_assemble(spark, tmp_path):
    spark.createDataFrame([("p1", " 10 ", "Y"), ("p2", "na", "no"), ("p2", "7", "no")], "pid string, area string, vac string").write.parquet(f"{tmp_path}/u.parquet")
    spark.createDataFrame([("s1", "p1", "2020-03-04", 100), ("s2", "p2", "bad", 50)], "sid string, pid string, d string, price long").coalesce(1).write.option("header", True).csv(f"{tmp_path}/s.csv")
    doc = {
        "data": {
            "load": {
                "geo": {"filename": "u.parquet", "load": {"key": "pid", "area": ["area", "float"], "is_vacant": ["vac", "bool"]}, "dupes": {"subset": ["key"], "sort_by": [["area", "desc"]]}},
                "deeds": {"filename": "s.csv", "load": {"key_sale": "sid", "key": "pid", "sale_date": ["d", "datetime", "%Y-%m-%d"], "sale_price": ["price", "float"]}, "calc": {"half": ["/", "sale_price", 2]}},
            },
            "process": {"merge": {"universe": ["geo"], "sales": ["deeds"]}, "fill": {"universe": {"zero": ["area"]}}},
        },
        "modeling": {"model_groups": {"land": {"filter": ["==", "is_vacant", True]}}},
    }
    pair = settings.assemble(spark, settings.load(doc), str(tmp_path))
    assert rows(pair.universe.select("key", "area", "is_vacant", "model_group")) == [("p1", 10.0, True, "land"), ("p2", 7.0, False, "UNKNOWN")]
    assert rows(pair.sales.select("key_sale", "sale_date", "half", "sale_year_month")) == [("s1", dt.datetime(2020, 3, 4), 50.0, "2020-03"), ("s2", None, 25.0, None)]
    with pytest.raises(ValueError):
        settings.load_table(spark, {"filename": "x.shp"})


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "a", 1.5, 2.5), (2, None, "b", 3.5, 4.5)], "id long, xs array<int>, s string, lon double, lat double")
    writers.write_csv(df, f"{tmp_path}/c.csv")
    assert {r["xs"] for r in readers.read_any(spark, f"{tmp_path}/c.csv").collect()} == {"[1,2]", None}
    writers.write_geojson_lines(df, f"{tmp_path}/g", "lon", "lat")
    assert {json.loads(r[0])["geometry"]["coordinates"][0] for r in spark.read.text(f"{tmp_path}/g").collect()} == {1.5, 3.5}
    calls = []

    def make():
        calls.append(1)
        return df

    for _ in range(2):
        assert writers.memoised(spark, str(tmp_path), "step", make).count() == 2
    assert len(calls) == 1 and writers.delete(spark, f"{tmp_path}/step.parquet") and not writers.exists(spark, f"{tmp_path}/step.parquet")
    enrich = lambda d: (calls.append(1), d.withColumn("twice", F.col("id") * 2))[1]
    for _ in range(2):
        assert rows(writers.cached_columns(df, str(tmp_path), "e", "id", enrich).select("id", "twice")) == [(1, 2), (2, 4)]
    assert len(calls) == 2
    writers.cached_columns(df.where("id = 1"), str(tmp_path), "e", "id", enrich)
    assert len(calls) == 3
    # changed values are stored too, and new values under the same keys miss the cache
    more = lambda d: d.withColumns({"lon": F.col("lon") + 1, "up": F.upper("s")})
    for base in (df, df, df.withColumn("lon", F.col("lon") * 2)):
        want = rows(more(base))
        for _ in range(2):
            got = writers.cached_columns(base, str(tmp_path), "m", "id", more)
            assert got.columns == more(base).columns and rows(got) == want
    # left-out rows stay out, added rows are there
    less = lambda d: d.where("id = 2").withColumn("z", F.lit(1))
    assert rows(writers.cached_columns(df, str(tmp_path), "l", "id", less)) == rows(less(df))
    both = lambda d: d.unionByName(d.withColumn("id", F.col("id") + 10))
    assert rows(writers.cached_columns(df, str(tmp_path), "b", "id", both)) == rows(both(df))
    added, gone = writers.changed_rows(df.where("id = 1"), df.where("id = 2"), "id")
    assert rows(added) == [(2,)] and rows(gone) == [(1,)]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.5), (None, 2.0)], "k string, v double").coalesce(1)
    md = writers.markdown_table(df)
    assert md.splitlines()[0] == "| k | v |" and "| a | 1.5 |" in md
    assert writers.fill_template("{{ n }} of {{m}} {{x}}", {"n": 1, "m": 2}) == "1 of 2 {{x}}"
    assert "<td>1.5</td>" in writers.html_page("t", "# T\n\n" + md + "\n\ntext") and "<h1>T</h1>" in writers.html_page("t", "# T")
    with pytest.raises(ValueError):
        writers.markdown_table(df, limit=1)


def test_readers(spark):
    df = spark.createDataFrame([(1, (0.0, 1.0, 0.0, 1.0), None, 3, [(0.4,), (0.9,)]), (2, (5.0, 6.0, 5.0, 6.0), 10.0, None, [])], "id long, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, height double, num_floors int, sources array<struct<confidence:double>>")
    assert rows(readers.in_box(df, (0.5, 0.5, 2, 2)).select("id")) == [(1,)]
    got = {r["id"]: (r["height_best"], r["floors_best"], r["confidence"]) for r in readers.with_heights(df).collect()}
    assert got == {1: (pytest.approx(9.6), 3.0, 0.9), 2: (10.0, 3.0, None)}
    assert readers.columns_of(spark, f"{SMALL}/region.parquet") == ["r_regionkey", "r_name"]


def test_synthetic(spark):
    u = synthetic.parcels(spark, 30)
    s = synthetic.sales(u, synthetic.inflation(spark, "2020-01-01", "2021-12-31"), 0.2)
    assert u.count() == 900 and 100 < s.count() < 260 and s.where("sale_price < 0").count() == 0
    assert sorted(u.repartition(7).select("key", "total_value").collect()) == sorted(u.select("key", "total_value").collect())
    assert synthetic.income_sales(spark, 5, 2019, 2021).count() == 15


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), "a", float(d)) for d in (1, 1, 2, 5)], "ts timestamp, k string, v double")
    ev.write.parquet(f"{tmp_path}/in/x.parquet")
    stream = windows.stream_of(spark, f"{tmp_path}/in/x.parquet", ev.schema)
    got = windows.run_once(windows.windowed(stream, "ts", ["k"], "v"), "stream_test")
    assert rows(got.select("n", "total")) == rows(windows.windowed(ev, "ts", ["k"], "v").select("n", "total")) == [(1, 2.0), (1, 5.0), (2, 2.0)]
    q = windows.upsert_batches(stream.select("k", F.col("v").alias("version")), f"{tmp_path}/out", "k", "version", f"{tmp_path}/cp")
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/0")) == [("a", 5.0)]


def test_joins_of_hot_and_null_keys(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("a", 1), (None, 2)], "k string, v long")
    right = spark.createDataFrame([("h", "x"), ("a", "y"), (None, "z")], "k string, w string")
    for how, n in (("inner", 51), ("left", 52), ("left_semi", 51), ("left_anti", 1)):
        assert rows(salted_join(left, right, "k", how, 0.1, 1)) == rows(left.join(right, "k", how)) and left.join(right, "k", how).count() == n
    assert null_safe_join(left, right, ["k"]).count() == 52
    assert null_safe_join(left, left.groupBy("k").agg(F.max("v").alias("m")), ["k"]).count() == 52
