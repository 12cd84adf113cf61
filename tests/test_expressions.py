import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import calc, filters, text


def column(df, entry):
    return [r[0] for r in calc.calculate(df.coalesce(1), {"out": entry}).select("out").collect()]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (10, 2), (11, 0), (-11, 0), (None, 1), (5, None)], "a long, b long").coalesce(1)


def test_arithmetic(pairs):
    assert column(pairs, ["+", "a", "b"]) == [0, 2, 4, 6, 12, 11, -11, None, None]
    assert column(pairs, ["/", "a", "b"]) == [None, 1, 1, 1, 5, math.inf, -math.inf, None, None]
    assert column(pairs, ["/0", "a", "b"]) == [None, 1, 1, 1, 5, None, None, None, None]
    assert column(pairs, ["//", "a", "b"]) == [None, 1, 1, 1, 5, None, None, None, None]
    assert column(pairs, ["min", "a", "b"]) == [0, 1, 2, 3, 2, 0, -11, None, None]
    assert column(pairs, ["max", "a", 2]) == [2, 2, 2, 3, 10, 11, 2, None, 5]


def test_unary_numbers(spark):
    values = [3.14, 1.5, 1.49, 1.51, 10.1, 10.25, 10.51, 10.5, -43.8, 99.9]
    df = spark.createDataFrame([(v,) for v in values], "a double").coalesce(1)
    assert column(df, ["asint", "a"]) == [3, 1, 1, 1, 10, 10, 10, 10, -43, 99]
    assert column(df, ["round", "a"]) == [3, 2, 1, 2, 10, 10, 11, 10, -44, 100]
    assert column(df, ["floor", "a"]) == [3, 1, 1, 1, 10, 10, 10, 10, -44, 99]
    assert column(df, ["ceil", "a"]) == [4, 2, 2, 2, 11, 11, 11, 11, -43, 100]
    assert column(df, ["round_nearest", "a", 5]) == [5, 0, 0, 0, 10, 10, 10, 10, -45, 100]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1e300,)], "a double").coalesce(1)
    assert str(column(odd, ["floor", "a"])) == "[None, inf, None, 1e+300]"


def test_where_fill_map_join(spark):
    df = spark.createDataFrame([(10, 5, 5), (0, 20, 10), (-1, 40, 40), (None, 1, 2)], "market long, land long, impr long").coalesce(1)
    assert column(df, ["where", ["<=", "market", 0], ["+", "land", "impr"], "market"]) == [10, 30, 80, 3]
    hood = spark.createDataFrame([("a", "t"), ("", "u"), (" ", "v"), (None, "w"), ("N/A", "x")], "n string, t string").coalesce(1)
    assert column(hood, ["fillna", "n", "t"]) == ["a", "", " ", "w", "N/A"]
    assert column(hood, ["fillempty", "n", "t"]) == ["a", "u", "v", "w", "x"]
    q = spark.createDataFrame([(1, "f"), (2, "g")], "num long, txt string").coalesce(1)
    assert column(q, ["join", ["values", "num", "txt"], "str: - "]) == ["1 - f", "2 - g"]
    assert column(q, ["map", "num", {"1": "one"}]) == ["one", "2"]
    assert column(q, ["//", ["round_nearest", "num", 20], 20]) == [0, 0]


def test_strings(spark):
    df = spark.createDataFrame([("  00 12-A / b  ",), ("x",), (None,)], "s string").coalesce(1)
    assert column(df, ["strip", "s"]) == ["00 12-A / b", "x", None]
    assert column(df, ["stripkey", "s"]) == ["12-A/b", "x", None]
    assert column(df, ["striplzero", ["strip", "s"]]) == [" 12-A / b", "x", None]
    assert column(df, ["split_before", "s", "str:-"]) == ["  00 12", "x", None]
    assert column(df, ["split_after", "s", "str:-"]) == ["A / b  ", "x", None]
    assert column(df, ["substr", ["strip", "s"], {"left": -3}]) == ["/ b", "x", None]
    assert column(df, ["substr", ["strip", "s"], {"left": 1, "right": -2}]) == ["0 12-A /", "", None]
    assert column(df, ["replace", "s", {"12": "21", "A": "Z"}]) == ["  00 21-Z / b  ", "x", None]
    assert column(df, ["replace_regex", ["strip", "s"], {r"(\d+)-": r"<\1>$"}]) == ["00 <12>$A / b", "x", None]
    assert column(df, ["contains", "s", "str:[0-9]{2}-"]) == [True, False, False]
    assert column(df, ["contains_case_insensitive", "s", ["str:a /", "str:zz"]]) == [True, False, False]
    assert column(df, ["isin", "s", ["str: x "]]) == [False, True, False]
    assert column(df, ["==", "s", "str:x"]) == [False, True, False]
    assert column(df, ["!=", "s", "str:x"]) == [True, False, True]


def test_dates_and_errors(spark):
    df = spark.createDataFrame([("03/04/2021",), ("bad",), (None,)], "s string").coalesce(1)
    assert column(df, ["datetime", "s", "str:%d/%m/%Y"]) == [dt.datetime(2021, 4, 3), None, None]
    assert column(df, ["datetimestr", "s", "str:%d/%m/%Y"]) == ["2021-04-03", None, None]
    for bad in (["nope", "s"], [], ["+", "missing", 1], ["substr", "s", 3], ["geo_area", "str:sqft"]):
        with pytest.raises(ValueError):
            calc.calculate(df, {"x": bad})


def test_calculate_order_renames_and_temporaries(spark):
    df = spark.createDataFrame([(2, 3)], "a long, new_b long")
    got = calc.calculate(df, {"__temp_x": ["*", "a", "b"], "c": ["+", "__temp_x", 1], "a": ["+", "a", "c"]}, {"b": "new_b"})
    assert got.columns == ["a", "new_b", "c"] and got.collect()[0] == (9, 3, 7)
    assert calc.fields_of(["+", "a", ["*", "b", "str:x"]]) == {"a", "b"}


def test_tweak(spark):
    df = spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate([("apple", "1"), ("pear", "2"), ("fig", "3")])], "id long, fruit string, score string")
    got = calc.tweak(df, [{"field": "fruit", "key": "id", "values": {0: "kiwi", "2": "lime"}}, {"field": "score", "key": "fruit", "values": {"kiwi": "9"}}])
    assert sorted(got.collect()) == [(0, "kiwi", "9"), (1, "pear", "2"), (2, "lime", "3")]
    with pytest.raises(ValueError):
        calc.tweak(df, [{"field": "nope", "key": "id", "values": {}}])


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "abc"), (None, None)], "num long, str string").coalesce(1)


@pytest.mark.parametrize(
    ("f", "want"),
    [
        ([">", "num", 1], [False, False, True, True, False]), (["<", "num", 1], [True, False, False, False, True]), ([">=", "num", 1], [False, True, True, True, False]), (["<=", "num", 1], [True, True, False, False, True]),
        (["==", "num", 1], [False, True, False, False, False]), (["!=", "num", 1], [True, False, True, True, True]), (["isin", "str", ["a", "str:b"]], [True, True, False, False, False]), (["notin", "str", ["a", "b"]], [False, False, True, True, True]),
        (["contains", "str", "str:a"], [True, False, False, True, False]), (["contains_case_insensitive", "str", ["str:A", "C"]], [True, False, True, True, False]), (["isempty", "str"], [False] * 4 + [True]), (["iszero", "num"], [True] + [False] * 4),
        (["iszeroempty", "num"], [True] + [False] * 3 + [True]), ([], [False] * 5), (["not", [">", "num", 1]], [True, True, False, False, True]), ([">=", "str", "str:b"], [False, True, True, False, False]), (["==", "num", "num"], [True] * 4 + [False]),
    ],
)
def test_filters(four, f, want):
    assert [r[0] for r in four.select(filters.condition(four, f)).collect()] == want


def test_boolean_folds(spark):
    rows = [(a, b) for a in (0, 1) for b in (0, 1)]
    df = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    a, b = ["==", "a", 1], ["==", "b", 1]
    truth = {"and": lambda x, y: x and y, "or": lambda x, y: x or y, "nand": lambda x, y: not (x and y), "nor": lambda x, y: not (x or y), "xor": lambda x, y: x != y, "xnor": lambda x, y: x == y}
    for op, f in truth.items():
        assert [r[0] for r in df.select(filters.condition(df, [op, a, b])).collect()] == [bool(f(x, y)) for x, y in rows]
        assert [r[0] for r in df.select(filters.condition(df, [op, a])).collect()] == [bool(x) for x, _ in rows]


def test_bad_filters(four):
    for bad in ([">", "num", "a"], ["<", "num", "a"], ["isin", "str", "a"], ["notin", "str", "a"], ["contains", "str", ["a"]], ["and", [">", "num", "a"]]):
        with pytest.raises(ValueError):
            filters.validate(bad)
    assert filters.validate(["or", [">", "num", 1], ["isin", "str", ["a"]]])
    for bad in (["??", "num", 1], ["==", "num", "nope"], ["==", "nope", 1], ["not"]):
        with pytest.raises(ValueError):
            filters.condition(four, bad)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Y",), ("no",), ("",), ("n/a",), (None,), ("maybe",)], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.to_bool(F.col("s"), T.StringType(), True)).collect()] == [True, False, False, True, True, True]
    assert text.clean_names(["a b", "a-b", "a_b", "", "x"]) == ["a_b", "a_b_1", "a_b_2", "column", "x"]
    n = spark.createDataFrame([(1.26e9,), (-2.5e6,), (1234.0,), (7.0,), (None,)], "v double").coalesce(1)
    assert [r[0] for r in n.select(text.fancy(F.col("v"))).collect()] == ["1.3B", "-2.5M", "1.2K", "7.0", None]


def test_geo_area(spark):
    from tests.test_spatial import SQUARE, wkb

    df = spark.createDataFrame([(bytearray(wkb([SQUARE])),), (None,)], "geometry binary").coalesce(1)
    got = column(df, ["geo_area", "str:sqkm"])
    assert got[0] == pytest.approx(12363.7, rel=1e-3) and got[1] is None
