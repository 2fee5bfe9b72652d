"""Compare a query with its DuckDB SQL, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    kind = getattr(getattr(x, "dtype", None), "kind", "")
    if kind == "f" or isinstance(x, float):
        return None if math.isnan(x) else round(float(x), 9)
    if kind in ("i", "u"):
        return int(x)
    if kind == "b":
        return bool(x)
    return x if isinstance(x, int | bool) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(_plain, r))) for r in df.itertuples(index=False))


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
