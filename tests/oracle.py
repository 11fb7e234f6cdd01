"""Row-by-row comparison of a query with its SQL in DuckDB."""

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if x != x else x
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


def compare(spark, con, query, sql, sf_dir):
    """Both sides' sorted rows with columns in order of name."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = sorted(range(len(df.columns)), key=lambda k: df.columns[k]), sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    left = sorted((tuple(_plain(r[k]) for k in a) for r in df.collect()), key=repr)
    right = sorted((tuple(_plain(r[k]) for k in b) for r in rel.fetchall()), key=repr)
    return left, right
