"""Compare a query's rows with those of its SQL in DuckDB."""

import collections
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return collections.Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql):
    """Empty if both sides have the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    want, got = rows_of(names, result.fetchall()), rows_of(df.columns, df.collect())
    return [f"{side} {n} x {row}" for side, counter in (("spark", got - want), ("sql", want - got)) for row, n in list(counter.items())[:3]]
