"""Compare a registered query with its SQL on one scale, as the driver does."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if pd.api.types.is_scalar(x) and pd.isna(x) else round(x, 6) if isinstance(x, float) else x for x in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str = DATA) -> int:
    ours = query(spark, sf_dir).toPandas()
    theirs = connection(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns), (name, list(ours.columns), list(theirs.columns))
    a, b = _plain(ours), _plain(theirs)
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:3])
    return len(a)
