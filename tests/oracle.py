"""A query's rows against its SQL in DuckDB, as the driver compares them: columns by name, rows in any order."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    said = lambda x: "None" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    whole = lambda x: int(x) if isinstance(x, float) and not pd.isna(x) and x == int(x) else x
    return sorted(tuple(said(whole(x)) for x in r) for r in frame.itertuples(index=False, name=None))
