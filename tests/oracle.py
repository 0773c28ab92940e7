"""Holds a query's rows against its SQL over the same Parquet tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.asDict() if hasattr(v, "asDict") else v


def compare(df, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()]
    got = [tuple(plain(plain(r[c])) for c in order) for r in df.collect()]
    key = lambda r: tuple(map(repr, r))
    want.sort(key=key)
    got.sort(key=key)
    assert len(want) == len(got), (len(want), len(got))
    for a, b in zip(got, want):
        assert a == b, (a, b)
