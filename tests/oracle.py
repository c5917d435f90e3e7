"""Hold a query's rows against its SQL in DuckDB: columns by name, rows in any order, doubles at six decimals."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return round(x, 6) + 0.0
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    if x.__class__.__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def found(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def differences(df, sf_dir: str, sql: str) -> str:
    """'' if equal."""
    (cols, got), (want_cols, want) = found(df), expected(sf_dir, sql)
    if cols != want_cols:
        return f"columns {cols} vs {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} rows differ; {bad[:2]}" if bad else ""
