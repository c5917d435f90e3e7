"""Schemas of the logical tables and the checks on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def violations(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row of counts over ranking rows: null ids, targets other than 0 and 1, repeated pairs, features that aren't finite."""
    require(rows, ["query_id", "candidate_id", "target", *(features or [])])
    bad = F.lit(False)
    for c in features or []:
        bad |= F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("query_id").isNull()).alias("n_null_query"),
        F.count_if(F.col("candidate_id").isNull()).alias("n_null_candidate"),
        F.count_if(F.col("target").isNull() | ~F.col("target").isin(0, 1)).alias("n_bad_target"),
        (F.count("*") - F.count_distinct(F.struct("query_id", "candidate_id"))).alias("n_repeated"),
        F.count_if(bad).alias("n_not_finite"),
    )


def checked(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``rows`` in (query, candidate) order; ValueError if any rule of ``violations`` is broken."""
    found = violations(rows, features).first().asDict()
    broken = {k: v for k, v in found.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"invalid ranking rows: {broken}")
    return rows.orderBy("query_id", "candidate_id")


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join to a lookup table; ValueError where a key is absent from it."""
    out = rows.join(table.select(key, value), key, "left")
    if not out.where(F.col(value).isNull()).isEmpty():
        raise ValueError(f"keys of {key} without {value}")
    return out
