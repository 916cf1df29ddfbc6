"""Rows of a Spark query against those of its DuckDB SQL."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item") and not isinstance(v, str):
        v = v.item()
    if isinstance(v, bool | str):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_value(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark_rows, duck_rows):
    assert sorted(spark_rows.columns) == sorted(duck_rows.columns)
    assert rows(spark_rows) == rows(duck_rows)
