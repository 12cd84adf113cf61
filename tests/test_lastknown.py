import datetime as dt
import random

from plumbline.operators.lastknown import as_known_at
from tests.conftest import SMALL


def brute(events, versions, attr):
    out = {}
    for e in events:
        best = None
        for v in versions:
            if e[1] is None or e[2] is None or v[1] != e[1] or v[2] is None or v[3] is None or v[2] > e[2] or v[3] > e[2] or v[attr] is None or v[attr] != v[attr]:
                continue
            rank = (v[2], v[3], v[0])
            if best is None or rank > best[0]:
                best = (rank, v[attr], v[0])
        out[e[0]] = (None, None) if best is None else best[1:]
    return out


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_against_brute_force_with_and_without_hot_keys(spark):
    rnd = random.Random(3)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
    when = lambda: None if rnd.random() < 0.08 else day(rnd.randrange(40))
    events = [(i, key(), when(), "x") for i in range(400)]
    versions = [(i, key(), when(), when(), rnd.choice([True, False, None]), rnd.choice([1.5, 2.5, float("nan"), None])) for i in range(200)]
    ev = spark.createDataFrame(events, "row_id long, key string, at timestamp, vacant string")
    vs = spark.createDataFrame(versions, "vid long, key string, eff timestamp, rec timestamp, vacant boolean, area double")
    for share, least in ((1 / 64, 10**6), (0.05, 1)):
        got = {r["row_id"]: r for r in as_known_at(ev, vs, "key", "at", "eff", "rec", "vid", ["vacant", "area", "vid"], share, least).collect()}
        assert len(got) == len(events)
        for attr, i in (("vacant", 4), ("area", 5), ("vid", 0)):
            want = brute(events, versions, i)
            assert {k: (r[f"known_{attr}"], r[f"known_{attr}_id"]) for k, r in got.items()} == want
    empty = as_known_at(ev, vs.limit(0), "key", "at", "eff", "rec", "vid", ["vacant"])
    assert empty.where("known_vacant is not null").count() == 0 and empty.count() == len(events)
    assert as_known_at(ev.limit(0), vs, "key", "at", "eff", "rec", "vid", ["vacant"]).count() == 0


def test_repeated_events_and_ties(spark):
    ev = spark.createDataFrame([(1, "a", day(5))] * 2, "row_id long, key string, at timestamp")
    vs = spark.createDataFrame([(7, "a", day(5), day(5), True), (8, "a", day(5), day(5), False), (9, "a", day(5), day(6), True)], "vid long, key string, eff timestamp, rec timestamp, vacant boolean")
    got = as_known_at(ev, vs, "key", "at", "eff", "rec", "vid", ["vacant"]).collect()
    assert [(r["known_vacant"], r["known_vacant_id"]) for r in got] == [(False, 8)] * 2


def test_on_the_small_tables(spark):
    sales = spark.read.parquet(f"{SMALL}/sales.parquet").select("row_id", "key", "sale_date")
    status = spark.read.parquet(f"{SMALL}/parcel_status.parquet").unionByName(spark.read.parquet(f"{SMALL}/state_roll_status.parquet"))
    by_key = {}
    for v in status.select("status_id", "key", "effective_date", "recorded_at").collect():
        by_key.setdefault(v["key"], []).append(tuple(v))
    want = {}
    for s in sales.collect():
        want |= {k: v[0] for k, v in brute([tuple(s)], by_key.get(s["key"], []), 0).items()}
    got = as_known_at(sales, status, "key", "sale_date", "effective_date", "recorded_at", "status_id", ["status_id"])
    assert {r["row_id"]: r["known_status_id"] for r in got.collect()} == want
