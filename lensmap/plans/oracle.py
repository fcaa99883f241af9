"""Compare registered queries with their DuckDB oracle SQL.

Used by ``tools/oracle_check.py`` and the test-suite.  Values are compared
order-insensitively after rounding floats to 6 decimals; columns by name.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..sources.tables import TABLES


STRICT = False   # True: compare floats exactly, as a value hash would


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@dataclass
class Check:
    name: str
    rows: int
    oracle_rows: int | None
    same_columns: bool
    match: bool | None
    spark_sec: float
    oracle_sec: float
    detail: str = ""


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark: SparkSession, con, sf_dir: str, name: str, fn, sql: str | None) -> Check:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return Check(name, len(rows), None, True, None, ts, 0.0)
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    td = time.time() - t1
    same = sorted(cols) == sorted(dcols)
    detail = ""
    if same:
        order = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in order) for r in drows]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        a, b = sorted(rows, key=key), sorted(drows, key=key)
        match = a == b
        if not match:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            detail = "; ".join(f"spark={str(x)[:200]} oracle={str(y)[:200]}" for x, y in diff)
    else:
        match = False
        detail = f"spark cols {cols} oracle cols {dcols}"
    return Check(name, len(rows), len(drows), same, match, ts, td, detail)
