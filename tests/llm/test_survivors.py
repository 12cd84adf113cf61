import datetime as dt
import random

from pyspark.sql import functions as F

from plumbline.llm import queries, survivors as sv
from tests.conftest import SMALL


def test_sale_identities(spark):
    same = ["03-0000004-349---2018-02-25", "3-4-349---2018-2-25", "030000004349-20180225", " 03 0000004 349/2018-02-25", "#03-0000004-349_2018.02.25 ", "sale:03-0000004-349---2018-02-25"]
    other = ["03-0000004-349---2018-02-26", "03-0000004-349---2018-02-25-2", "030000004349-20180225-2", "03-0000004-3490---2018-02-25"]
    df = spark.createDataFrame([(x,) for x in same + other + ["", "n/a", None, "odd"]], "k string").select(sv.sale_identity(F.col("k")).alias("s"))
    got = [r["s"] for r in df.collect()]
    assert len(set(got[:6])) == 1 and got[0] not in got[6:]
    assert got[7] == got[8] and got[10:13] == [None] * 3 and got[13] == "=ODD"


def test_deed_identities(spark):
    same = [("1002", "0163"), ("0001002", "163"), ("OR 1002", "p. 163"), ("BK1002", "PG 163"), (" 1002 ", " 163"), ("1002/163", None), ("1002/163", "n/a")]
    other = [("1002", "164"), ("1003", "163"), ("unknown", "163"), ("1002", None), (None, None)]
    df = spark.createDataFrame([("03-0000004-349", *x) for x in same + other], "k string, b string, p string")
    deed, whole = sv.deed_identity(F.col("k"), F.col("b"), F.col("p"))
    got = [r[0] for r in df.select(F.when(whole, deed)).collect()]
    assert len(set(got[:7])) == 1 and got[0] not in got[7:] and got[9:] == [None] * 3


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(up)}


def test_components_of_chains_stars_and_cycles(spark):
    rnd = random.Random(4)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 40)] + [("y1", "y2"), ("y2", "y3"), ("y3", "y1"), ("z", "z")]
    pairs += [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(50)]
    got = {r["node"]: r["label"] for r in sv.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {k: v for k, v in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert sv.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_found_against_brute_force(spark):
    got = {tuple(r) for r in queries.p4_found(spark, SMALL).collect()}
    ranks = {r["feed"]: r["trust_rank"] for r in spark.read.parquet(f"{SMALL}/feeds.parquet").collect()}
    want = set()

    def missing(v):
        return v is None or v != v or isinstance(v, str) and v.strip().lower() in sv.NULL_TOKENS

    def survive(kind, groups, fields, rid):
        for members in groups:
            if len(members) > 1:
                first = min(m[rid] for m in members)
                for f in fields:
                    have = [m for m in members if not missing(m[f])]
                    if have:
                        best = max(have, key=lambda m: (-ranks.get(m["feed"], 99), m["recorded_at"] or dt.datetime.min, m[rid]))
                        want.add((kind, first, f, best[rid]))

    sales = spark.read.parquet(f"{SMALL}/sales.parquet")
    deed, whole = sv.deed_identity(F.col("key"), F.col("deed_book"), F.col("deed_page"))
    recs = sales.withColumns({"s": sv.sale_identity(F.col("key_sale")), "d": F.when(whole, deed)}).collect()
    links = union_find([(("row", r["row_id"]), ("id", k, r[k])) for r in recs for k in "sd" if r[k] is not None])
    by = {}
    for r in recs:
        by.setdefault(links.get(("row", r["row_id"]), r["row_id"]), []).append(r)
    survive("sale", by.values(), queries.SALE_FIELDS, "row_id")
    by = {}
    for r in spark.read.parquet(f"{SMALL}/universe.parquet").collect():
        if r["key"] is not None:
            by.setdefault(r["key"], []).append(r)
    survive("parcel", by.values(), queries.PARCEL_FIELDS, "record_id")
    assert got == want and any(g[0] == "sale" for g in got)


def test_consensus_elects_tokens_and_returns_existing_values(spark):
    rows = [(1, "g", "12 Old Mill Road", 1.0), (2, "g", "12 Old Mill Rd", 0.4), (3, "g", "12 Mill Road", 0.9), (4, "g", "unknown", 5.0), (5, "g", None, 5.0), (6, "h", "x", 1.0), (7, "k", "n/a", 1.0), (8, "k", "-", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, a string, w double")
    got = sv.surviving_values(df, "g", "id", ["a"], F.col("w")).collect()
    assert [(r["group_id"], r["field"], r["value"], r["consensus"], r["row_id"]) for r in got] == [(1, "a", "12 Old Mill Road", "12 Old Mill Road", 1)]
    many = spark.createDataFrame([(i, "g", f"1 Elm Street unit {i}", 1.0) for i in range(300)] + [(1000 + i, "g", "1 Elm Street", 1.0) for i in range(400)], "id long, g string, a string, w double")
    assert [r["value"] for r in sv.surviving_values(many, "g", "id", ["a"], F.col("w")).collect()] == ["1 Elm Street"]
    assert sv.surviving_values(df.limit(0), "g", "id", ["a"], F.col("w")).count() == 0


def test_consensus_covers_sales_and_parcels(spark):
    found = {(r["record_type"], r["group_id"], r["field"]) for r in queries.p4_found(spark, SMALL).collect()}
    got = queries.p4_consensus(spark, SMALL).collect()
    voted = {(r["record_type"], r["group_id"], r["field"]) for r in got}
    assert len(voted) == len(got) and all(r["value"] and r["row_id"] >= r["group_id"] for r in got)
    # every group and field that has a survivor has a vote, and sales vote on their key too
    assert {v for v in voted if v[2] != "key_sale"} == found
    assert any(v[2] == "key_sale" for v in voted)


def test_order_consensus_over_many_values(spark):
    # more distinct values than a block and a merge of blocks hold; the first record's value survives
    n = 1500
    rows = [(i, "g", f"{'x ' * (i % 3)}Elm {i} Street {i % 7}", float(-((i * 37) % n))) for i in range(n)] + [(n + 1, "h", "a", 1.0), (n + 2, "h", None, 5.0), (n + 3, "k", "alone", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, a string, r double")
    got = {(r["group_id"], r["field"], r["row_id"]) for r in sv.surviving_rows(df, "g", "id", ["a"], [F.col("r")], "t").collect()}
    assert got == {(0, "a", 0), (n + 1, "a", n + 1)}
