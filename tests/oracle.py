"""Compare queries with their statements in DuckDB: rows as multisets, columns by name, values exactly."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, (int, float)) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(con, sql, df):
    """None if equal, else a short account."""
    con_df = con.execute(sql)
    names = [d[0] for d in con_df.description]
    want, got = rows_of(names, con_df.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    if want != got:
        return f"{sum(want.values())} and {sum(got.values())} rows; only in DuckDB {list((want - got).items())[:2]}, only in Spark {list((got - want).items())[:2]}"
    return None
