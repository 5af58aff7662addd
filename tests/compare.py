"""Run a query in Spark and its SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.01")


def tables(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (f[cols].sort_values(cols, ignore_index=True) for f in (got, want))
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)
