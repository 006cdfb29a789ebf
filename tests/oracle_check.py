"""Side-by-side check: a Spark query against its DuckDB SQL on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype(object).where(pd.notnull(df), None)
    rows = sorted(map(tuple, df.values.tolist()), key=lambda r: tuple((x is None, str(x)) for x in r))
    return pd.DataFrame(rows, columns=df.columns)


def compare(spark_df, con, sql: str):
    """Return (ok, message) comparing row counts, column names and values."""
    left = spark_df.toPandas()
    right = con.execute(sql).fetchdf()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns differ: {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"row count differs: {len(left)} vs {len(right)}"
    a, b = _norm(left), _norm(right)
    for col in a.columns:
        for i, (x, y) in enumerate(zip(a[col], b[col])):
            if x is None and y is None:
                continue
            if isinstance(x, float) or isinstance(y, float):
                if x is None or y is None or abs(float(x) - float(y)) > 1e-9:
                    return False, f"{col} row {i}: {x!r} vs {y!r}"
            elif str(x) != str(y):
                return False, f"{col} row {i}: {x!r} vs {y!r}"
    return True, f"{len(a)} rows match"
