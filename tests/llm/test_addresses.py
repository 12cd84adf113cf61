import random

from pyspark.sql import functions as F

from plumbline.llm import addresses as ad
from plumbline.session import cut_counted
from tests.conftest import SMALL

TYPES = {"road": ["rd", "road"], "street": ["st", "str", "street"], "court": ["ct", "crt", "court"]}
DIRS = {"north": ["n", "no", "north"], "south": ["s", "so", "south"]}
STREETS = [("mill run", "road", None), ("old harbor", "street", "north"), ("old harbor", "street", "south"), ("quince", "court", None), ("quince", "road", None), ("tall cedar", "court", "south"), ("10th", "street", "north"), ("northern star", "road", "north")]
CITIES = [("elmton", "00101"), ("oak springs", "00102"), ("oak mills", "00103")]


def test_tokens_and_edits(spark):
    lines = spark.createDataFrame([("Unit 1B, 4931 No. O'Neil 10th Pl., #3-c 00281-1234",), (None,), ("",)], "a string").coalesce(1)
    got = lines.select(ad.tokens(F.col("a")).alias("t"))
    assert [r["t"] for r in got.collect()] == [["unit", "1b", ",", "4931", "no", "oneil", "10th", "pl", ",", "#", "3c", "00281-1234"], [], []]
    words = spark.createDataFrame([("10th",), ("10",), ("00281-1234",), ("00281",), ("1b",)], "a string").coalesce(1)
    assert [tuple(r) for r in words.select(ad.is_number(F.col("a")), ad.is_zip(F.col("a"))).collect()] == [(False, False), (True, False), (False, True), (False, True), (True, False)]
    pairs = [("mill", x, True) for x in ("mil", "miill", "mlil", "mull", "mill")] + [("mill", x, False) for x in ("mole", "ml")]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert df.where((ad.one_edit(F.col("a"), F.col("b")) != F.col("same")) | (ad.one_edit(F.col("b"), F.col("a")) != F.col("same"))).count() == 0


def test_parts_of_a_line():
    part = lambda line, units=("apt", "unit"): ad._parts(line.split(), set(units), frozenset(["qx"]))
    assert part("apt 2 , 1996 w rugged st , elmton , qx 00297-2260") == ("1996", "2", "00297", ["w", "rugged", "st", "elmton"])
    assert part("elm rd 0012 # b 00101") == ("12", "b", "00101", ["elm", "rd"])
    assert part("12345 elm rd elmton 00101") == ("12345", None, "00101", ["elm", "rd", "elmton"])
    assert part("0 elm rd") is None and part("elm rd 00101") is None and part("") is None
    assert part("7 county road 12") == ("7", None, None, ["county", "road", "12"])


def write(rnd, place, omit=0.06, typo=0.08):
    number, (name, kind, way), unit, (city, code) = place
    def slip(w):
        if rnd.random() < typo and len(w) > 4:
            i = rnd.randrange(len(w) - 1)
            return rnd.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        return w
    words = slip(name).split() if rnd.random() > 0.05 else [name.replace(" ", "")]
    twin = sum(s[0] == name for s in STREETS) > 1
    k = rnd.choice(TYPES[kind]) if twin or rnd.random() > omit else ""
    w = rnd.choice(DIRS[way]) if way and (twin or rnd.random() > omit) else ""
    street = " ".join(x for x in ([w, *words, k] if rnd.random() > 0.2 else [*words, k, w]) if x)
    line = f"{number} {street}" if rnd.random() > 0.15 else f"{street} {number}"
    if unit:
        line += rnd.choice([", Apt ", " #", ", Unit "]) + unit
    where = rnd.choice([f", {slip(city)}, QX {code}", f", {slip(city)} {code}", f", {code}", f", {slip(city)}, QX", f" {city} QX {code}-1234"])
    line += where
    return rnd.choice([line, line.upper(), line.title(), f" {line}  "])


def test_against_known_places(spark):
    rnd = random.Random(14)
    places = [(n, s, u, c) for c in CITIES for s in STREETS for n in range(101, 125) for u in ((None,) if n % 5 else ("1", "2a"))]
    rows, place_of = [], {}
    for i in range(5000):
        p = rnd.choice(places)
        rows.append((f"k{i}", write(rnd, p), p[3][0].title() if rnd.random() > 0.05 else None))
        place_of[f"k{i}"] = p
    rows += [("x1", None, "Elmton"), ("x2", "Unknown", "Elmton"), ("x3", "0 mill run rd, elmton, qx 00101", "Elmton"), ("x4", "0 mill run rd, elmton, qx 00101", "Elmton"), (None, rows[0][1], None), ("x5", "", None), ("x6", "Mill Run Rd, Elmton", None)]
    df = spark.createDataFrame(rows, "key string, address string, city string")
    got = {tuple(r) for r in ad.same_place_pairs(df, "key", "address", "city").collect()}
    by = {}
    for k, p in place_of.items():
        by.setdefault(p, []).append(k)
    want = {(a, b) if a < b else (b, a) for ks in by.values() for i, a in enumerate(ks) for b in ks[:i]}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    assert ad.same_place_pairs(df.limit(0), "key", "address", "city").count() == 0


def test_small_tables(spark):
    u = spark.read.parquet(f"{SMALL}/universe.parquet")
    got = ad.same_place_pairs(u, "key", "address", "city").collect()
    assert got and all(r["key_a"] < r["key_b"] for r in got) and len(set(got)) == len(got)


def test_copies_of_the_table_change_nothing(spark):
    rnd = random.Random(15)
    places = [(n, s, None, c) for c in CITIES for s in STREETS for n in range(101, 120)]
    rows = [(f"k{i}", write(rnd, p), p[3][0]) for i, p in enumerate(rnd.choice(places) for _ in range(700))]
    df = spark.createDataFrame(rows, "key string, address string, city string")
    one = {tuple(r) for r in ad.same_place_pairs(df, "key", "address", "city").collect()}
    more = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    assert one and {tuple(r) for r in ad.same_place_pairs(more, "key", "address", "city").collect()} == one


def test_rounds_take_few_jobs(spark):
    """What the driver holds grows with the jobs and plans of a query; tables that were counted once are not counted or sorted again."""
    rnd = random.Random(15)
    places = [(n, s, None, c) for c in CITIES for s in STREETS for n in range(101, 120)]
    rows = [(f"k{i}", write(rnd, p), p[3][0]) for i, p in enumerate(rnd.choice(places) for _ in range(700))]
    df = spark.createDataFrame(rows, "key string, address string, city string")
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "few jobs")
    try:
        got = {tuple(r) for r in ad.same_place_pairs(df, "key", "address", "city").collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = len(sc.statusTracker().getJobIdsForGroup("few jobs"))
    assert got and 0 < jobs <= 200, jobs


def test_large_lexicons_change_nothing(spark, monkeypatch):
    rnd = random.Random(16)
    places = [(n, s, None, c) for c in CITIES for s in STREETS for n in range(101, 112)]
    rows = [(f"k{i}", write(rnd, p), p[3][0] if i % 9 else None) for i, p in enumerate(rnd.choice(places) for _ in range(500))]
    df = spark.createDataFrame(rows, "key string, address string, city string")
    one = {tuple(r) for r in ad.same_place_pairs(df, "key", "address", "city").collect()}
    # as if every table were too large to be broadcast
    monkeypatch.setattr(ad, "small", lambda df, *_: df)
    monkeypatch.setattr(ad, "checked_join", lambda left, right, key, how="inner", **_: ad.salted_join(left, right, key, how))
    assert one and {tuple(r) for r in ad.same_place_pairs(df, "key", "address", "city").collect()} == one


def test_cut_counts_rows(spark):
    df, n, odd = cut_counted(spark.range(10), F.col("id") % 2 == 1)
    assert (n, odd, df.count()) == (10, 5, 10)
    none, n = cut_counted(df.where("id > 20").join(df, "id"))
    assert (n, none.count()) == (0, 0)
