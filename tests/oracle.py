"""Compares a registered query with its SQL in DuckDB, as sorted rows."""

import datetime
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def value(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if not float(x).is_integer() else str(int(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    return str(x)


def differ(spark, sf, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    df = f(spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(value(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {sorted(cols)} and {names}"
    at = [cols.index(n) for n in names]
    want = sorted(tuple(value(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} rows and {len(want)}; only here {only[0]}, only there {only[1]}"
    return ""
