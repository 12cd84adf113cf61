"""Hot groups, clashing names, very long texts, nulls everywhere and empty tables, for every operator tagged llm."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import addresses, leaks, mixture, percentiles, survivors, truncation
from plumbline.operators import lastknown, skew
from tests.conftest import SMALL, rows


@pytest.fixture
def hot(monkeypatch):
    """Makes ordinary keys count as hot, so the salted ways are taken."""
    for f in (lastknown.hot_keys, skew.salted_join):
        d = list(f.__defaults__)
        monkeypatch.setattr(f, "__defaults__", tuple(0.01 if x == lastknown.HOT_SHARE else 1 if x == lastknown.HOT_ROWS else x for x in d))


def test_hot_ways_give_the_same_rows(spark, hot):
    from plumbline.llm import queries

    small = {n: rows(queries.QUERIES[n](spark, SMALL)) for n in ("p1_percentiles", "p3_found", "p4_found", "p8_found")}
    lastknown.hot_keys.__defaults__ = (lastknown.HOT_SHARE, 10**9)
    for n, got in small.items():
        assert rows(queries.QUERIES[n](spark, SMALL)) == got, n


def test_percentiles_of_one_value_that_is_a_third(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("part"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 100).cast("double")).alias("x"), F.lit("clash").alias("reached"))
    got = {r["part"]: (r["n"], r["p5000"]) for r in percentiles.percentiles(percentiles.value_counts(df, ["part"], "x"), ["part"], [5000]).collect()}
    assert got["hot"] == (10_000, 7.0) and len(got) == 51
    with pytest.raises(ValueError):
        percentiles.value_counts(df, ["n"], "x")
    null = spark.createDataFrame([(None, None, 1)], "g string, x double, v int")
    assert percentiles.percentiles(percentiles.value_counts(null, ["g"], "x"), ["g"], [5000]).count() == 0


def test_survivors_of_a_large_group_with_clashes_and_nulls(spark):
    data = [(i, "k" if i % 3 == 0 else f"u{i}", None if i % 2 else f"v{i}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 7) if i % 5 else None, "f", i % 4, "x") for i in range(3000)]
    df = spark.createDataFrame(data, "id long, s string, a string, recorded_at timestamp, feed string, trust_rank int, label string").withColumns({"group": F.lit("old"), "d": F.lit(None).cast("string"), "x0": F.lit(1), "n": F.lit(2)})
    feeds = spark.createDataFrame([("f", 3), ("f", 3), (None, 1)], "feed string, trust_rank int")
    got = survivors.linked_groups(survivors.trusted(df, feeds), "s", "d")
    assert got.count() == 3000 and {"label", "x0", "n", "trust_rank", "group"} <= set(got.columns) and got.where("group = 'old'").count() == 0
    one = survivors.surviving_rows(got, "group", "id", ["a", "d"], [-F.col("trust_rank"), F.col("recorded_at")], "t").collect()
    want = max((x for x in data if x[1] == "k" and x[2]), key=lambda x: (x[3] or dt.datetime.min, x[0]))
    assert [tuple(r) for r in one] == [("t", 0, "a", want[0])]
    nulls = spark.createDataFrame([(1, None, None), (2, None, None)], "id long, s string, d string")
    assert survivors.linked_groups(nulls, "s", "d").where("group is null").count() == 2
    assert survivors.linked_groups(nulls.limit(0), "s", "d").count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(400_000))
    passage = " ".join(long.split()[-20:])
    docs = spark.createDataFrame([(1, long, "s", "c"), (2, long + " and so", "s", "c"), (3, "", None, "c"), (4, None, "s", None)], "doc_id long, text string, source string, evidence string")
    items = spark.createDataFrame([(7, passage, 1)], "item_id long, text string, doc_id int")
    assert {tuple(r) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, 7), (2, 7)}
    assert {r["doc_id"] for r in leaks.removal_spans(docs, "doc_id", "text", items, "item_id", "text").collect()} == {1, 2}
    got = {r["doc_id"]: r["evidence"] for r in truncation.find_truncated(docs, "doc_id", "source", "text").collect()}
    assert got == {1: "sentence", 2: "sentence", 3: None, 4: None}
    n = [r[0] for r in docs.orderBy("doc_id").select(mixture.token_count(F.col("text"))).collect()]
    assert n[0] > 400_000 and n[2:] == [0, 0]
    u = spark.createDataFrame([("a", "12 " + long[:2_000_000], None, 1), ("b", "12 Elm Street", "X", 2), ("c", "12 ELM STREET", "X", 3), (None, "12 Elm Street", "X", 4), ("d", None, None, 5)], "key string, address string, city string, number int")
    assert {tuple(r) for r in addresses.same_place_pairs(u, "key", "address", "city").collect()} == {("b", "c")}


def test_a_third_of_all_texts_are_copies(spark):
    body = "\\section{A}\n" + " ".join(f"word{i % 97}" for i in range(200)) + "."
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(body)).otherwise(F.concat(F.lit("\\section{B} Text number "), F.col("id"), F.lit("."))).alias("text"), F.lit("s").alias("source"))
    assert truncation.find_truncated(docs, "doc_id", "source", "text").where("evidence is not null").count() == 0
    sized = docs.withColumn("n", F.length("text").cast("long"))
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    sel, shares = mixture.mix(sized, "doc_id", "source", "n", targets, total=50_000)
    assert sel.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] == shares.first()["actual_tokens"] == 50_000


def test_ties_and_repeats(spark):
    same = spark.createDataFrame([(1, "g", "Elm St"), (1, "g", "Elm St"), (2, "g", "Oak St")], "id long, g string, a string")
    got = survivors.surviving_values(same, "g", "id", ["a"], F.lit(1.0)).collect()
    assert [(r["group_id"], r["value"], r["row_id"]) for r in got] == [(1, "Elm St", 1)]
    two = spark.createDataFrame([("x", "5 Elm Rd, Oakton, QX 00101", "Oakton")] * 2 + [("y", "5 Elm Rd, Oakton, QX 00101", "Oakton")], "key string, address string, city string")
    assert {tuple(r) for r in addresses.same_place_pairs(two, "key", "address", "city").collect()} == {("x", "y")}
