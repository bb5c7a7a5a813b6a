"""Comparison of Spark and DuckDB results."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        v = round(v, 8)
        return int(v) if v == int(v) else v
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(frame):
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)))
