"""Rows of a Spark query and of its SQL in DuckDB, in one form."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def canonical(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        f = round(float(v), 9)
        return str(int(f)) if f == int(f) else str(f)
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


def same(spark_df, con, sql: str) -> tuple[list, list]:
    cols = sorted(spark_df.columns)
    own = sorted(tuple(map(str, map(canonical, r))) for r in spark_df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    other = sorted(tuple(str(canonical(r[i])) for i in at) for r in cur.fetchall())
    return own, other
