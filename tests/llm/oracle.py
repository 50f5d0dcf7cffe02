"""Rows of a query and of its SQL, in one comparable form."""

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(repr(tuple(r[n] for n in names)) for r in got.collect())
    b = sorted(repr(r) for r in want.select(", ".join(names)).fetchall())
    assert a == b
    return len(a)
