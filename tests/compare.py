"""Side-by-side run of a registered query and its oracle text."""

import math
import os

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck_connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, str, bool)):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_bag(df):
    return sorted(df.columns), bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), bag(columns, cur.fetchall())


def difference(left, right, limit=4):
    """Short text of what differs, or None."""
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(map(repr, left[1])), set(map(repr, right[1]))
    return f"{left[0]} rows {len(left[1])} / {len(right[1])}; spark only {sorted(a - b)[:limit]}; sql only {sorted(b - a)[:limit]}"
