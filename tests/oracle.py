"""Compare a registered query with its SQL on the same tables."""

import glob
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
