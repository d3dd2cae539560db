"""Local stand-in for the driver's correctness gate: Spark query vs DuckDB SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from cohortlab.sources.fixtures import DRIVER_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    sp = spark_df.toPandas()
    dk = con.execute(sql).fetchdf()
    sc, dc = sorted(sp.columns), sorted(dk.columns)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sp) != len(dk):
        return False, f"rows differ: spark={len(sp)} duck={len(dk)}"
    rows_s = sorted((tuple(_norm(x) for x in r) for r in sp[sc].itertuples(index=False)), key=repr)
    rows_d = sorted((tuple(_norm(x) for x in r) for r in dk[dc].itertuples(index=False)), key=repr)
    for a, b in zip(rows_s, rows_d):
        if a != b:
            return False, f"first differing row:\n spark={a}\n duck ={b}"
    return True, f"{len(sp)} rows equal"
