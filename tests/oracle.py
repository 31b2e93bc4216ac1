"""Runs a query and its SQL over the same tables and compares names, counts and values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def compare(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns), (names, got.columns)
    order = sorted(names)
    mine = sorted((tuple(plain(r.asDict(recursive=True)[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert repr(a) == repr(b) or a == b, (order, a, b)
    return len(mine)
