"""A query against its SQL in DuckDB, as multisets of rows with columns in name order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf_dir, query, sql):
    with duckdb.connect() as db:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        want = db.sql(sql)
        names, rows = want.columns, want.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    at = [names.index(c) for c in order]
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in rows)
