"""Runs a query beside its SQL on the same Parquet tables and compares rows."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def compare(spark, sf, query, sql):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}'")
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    names = [d[0] for d in c.execute(f"DESCRIBE {sql}").fetchall()]
    want = rows(names, c.execute(sql).fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    assert got == want, [(a, b) for a, b in zip(got, want) if a != b][:3]
    return len(got)
