"""Compare a query with its SQL on the smallest tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else x  # integers with nulls come as floats

    return list(frame.columns), sorted(repr([value(x) for x in row]) for row in frame.astype(object).itertuples(index=False, name=None))


def assert_same(spark, query, sql):
    got, want = plain(query(spark, FOLDER).toPandas()), plain(connect().execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
