"""Run registered queries next to their SQL twins and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    """Engine-neutral form of a value; type differences such as int and float stay visible."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("float", round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr), sorted(names)


def compare(spark, con, fn, sql, sf):
    """Empty text when both sides agree, else what differs."""
    df = fn(spark, sf)
    left, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right, other = rows([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} <> {other}", len(left)
    if left == right:
        return "", len(left)
    a, b = set(map(repr, left)), set(map(repr, right))
    return (
        f"rows {len(left)} <> {len(right)}; columns {names}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}",
        len(left),
    )


def main() -> None:
    from waymark.plans import catalog
    from waymark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in catalog.SQL:
                msg, n = compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], sf)
            else:
                msg, n = "", len(catalog.QUERIES[name](spark, sf).collect())
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += bool(msg)
        kind = "" if name in catalog.SQL else " (rows only)"
        print(f"{'FAIL' if msg else 'ok  '} {name}{kind} rows={n} {time.time() - start:.1f}s {msg[:2500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
