"""Runs a query and its SQL over the same tables and compares rows as multisets of rounded values."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or hasattr(x, "item") and isinstance(x.item(), bool):
        return bool(x)
    if isinstance(x, datetime.datetime):
        return str(x.date()) if x.time() == datetime.time() else str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        f = round(float(x), 5)
        return 0.0 if f == 0 else f
    return str(x)


def difference(spark_df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(value(r[c]) for c in order) for r in got)
    b = Counter(tuple(value(r[names.index(c)]) for c in order) for r in want)
    if a != b:
        return f"{len(got)} and {len(want)} rows; {order}; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return ""
