"""Comparison of a query with its SQL over the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def same(spark, folder, fn, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = fn(spark, folder)
    cols = sorted(df.columns)
    mine = Counter(tuple(normal(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(normal(r[i]) for i in at) for r in cur.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    return sum(mine.values())
