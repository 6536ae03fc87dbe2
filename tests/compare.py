from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def keyed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def same(spark_df, connection, sql: str) -> None:
    got = keyed(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    made = connection.sql(sql)
    want = keyed(made.columns, made.fetchall())
    assert sorted(spark_df.columns) == sorted(made.columns)
    assert got == want
    assert got
