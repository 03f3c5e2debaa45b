"""Compares a query with its SQL: same columns, types and rows, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(df, con, sql):
    columns, rows = sorted(df.columns), df.collect()
    cur = con.execute(sql)
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert columns == sorted(names)
    plain = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    key = lambda t: tuple((v is None, v) for v in t)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want), key=key)
    assert a == b
    assert not a or [type(v) for v in a[0]] == [type(v) for v in b[0]]
