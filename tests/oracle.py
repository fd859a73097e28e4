"""Compare a query's rows with its SQL in DuckDB, columns and values alike."""

import glob
import math
import os


def connect(directory):
    duckdb = __import__("duckdb")
    c = duckdb.connect()
    for p in glob.glob(directory + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, int):
        return float(v)
    return v if isinstance(v, str) else str(v)


def rows_of_sql(connection, sql):
    cur = connection.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_spark(df):
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in df.collect()), key=repr)
