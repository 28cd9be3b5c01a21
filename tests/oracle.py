"""Compare a query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool,)) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return repr(round(float(value), 6) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(_text, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))
