"""Run named queries against their SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if pd.isna(v):
                cells.append("NULL")
            elif isinstance(v, float):
                cells.append(repr(v + 0.0))
            elif hasattr(v, "isoformat"):
                cells.append(pd.Timestamp(v).isoformat())
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return list(pdf.columns), sorted(rows)


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1.01e-6)
    except ValueError:
        return False


def differences(spark_pdf, duck_pdf):
    """Problems found: exact where texts agree, else to the last rounded digit."""
    cols_a, rows_a = canonical(spark_pdf)
    cols_b, rows_b = canonical(duck_pdf)
    if cols_a != cols_b:
        return [f"columns {cols_a} != {cols_b}"]
    if len(rows_a) != len(rows_b):
        return [f"rows {len(rows_a)} != {len(rows_b)}"]
    return [(x, y) for x, y in zip(rows_a, rows_b) if x != y]
