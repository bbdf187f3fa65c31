"""Rows of a query against its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    def plain(v):
        if v is None or v is np.ma.masked or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
            return "null"
        return repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def oracle(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            path = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return rows(con.sql(sql).df())
