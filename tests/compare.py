"""Side-by-side comparison of a query and its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(8) + 0.0
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else (round(float(v), 8) if type(v).__name__ == "Decimal" else str(v)))
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty if both hold the same rows, in whatever order."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    a, b = _normal(spark_rows), _normal(sql_rows)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            bad = ~((a[c] - b[c]).abs().le(2e-8) | (a[c].isna() & b[c].isna()))
        else:
            bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            return f"{c}: {int(bad.sum())} rows differ, first {a[c][bad.idxmax()]!r} and {b[c][bad.idxmax()]!r}"
    return ""
