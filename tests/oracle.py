"""Comparison of a query with its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if np.isnan(value) else round(float(value), 6)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    return int(value) if isinstance(value, (int, np.integer)) else str(value)


def rows_of(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    numbers = lambda r: tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r)
    return Counter(numbers(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False))


def assert_same(query, sql: str, spark, folder: str) -> None:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.sql(sql).df()
    got = query(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
