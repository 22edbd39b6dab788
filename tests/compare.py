"""Runs a query and its SQL over one folder of tables and compares rows, in any order."""

import math
from pathlib import Path

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted([columns[i] for i in order]), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, cur = query(spark, folder), con.execute(sql)
    names = [d[0] for d in cur.description]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1], next((x, y) for x, y in zip(a[1], b[1], strict=False) if x != y) if len(a[1]) == len(b[1]) else (len(a[1]), len(b[1]))
