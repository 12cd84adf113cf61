"""Runs registered queries next to their SQL in DuckDB: ``python -m tests.parity [folder] [name part ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings universe sales parcel_status state_roll_status block_groups feeds eval_items source_targets".split()


#: With PARITY_STRICT set, floating-point values must be the same to the last bit.
STRICT = bool(os.environ.get("PARITY_STRICT"))


def plain(v):
    if isinstance(v, float):
        # a NaN equals nothing, as in the driver's comparison
        return object() if math.isnan(v) else (v if STRICT else float(f"{v:.10g}")) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, f, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = f(spark, folder)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in res.description}
    want_kind = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if want_kind.get(k, k) != kinds[c]}
    if odd:
        return f"types {odd}"
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=key)
    if got == want:
        return None
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"{len(got)} rows against {len(want)}; only here {sorted(a - b, key=key)[:2]}, only there {sorted(b - a, key=key)[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, columns {order}: {bad[0]}"


def main() -> int:
    import __spark_entry__ as e
    from plumbline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    sql = e.oracle_sql()
    for name, f in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            said = compare(spark, con, folder, f, sql[name]) if name in sql else f"rows only: {f(spark, folder).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
