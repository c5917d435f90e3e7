"""Pairs drawn by hash order in place of a seeded random draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import stable_order
from .splits import dense_index


def next_by_hash(rows: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Each row beside the next one (columns other_...) in the hash order of its key, the last beside the first; inside
    each value of ``by``, or over all rows by a dense index, so that no task orders them all. A lone row has no pair."""
    if by:
        order = Window.partitionBy(by).orderBy(stable_order(F.col(by), F.col(key)), key)
        placed = rows.withColumn("__place", F.row_number().over(order) - 1).withColumn("__size", F.count("*").over(Window.partitionBy(by)))
    else:
        size = rows.agg(F.count("*").alias("__size"))
        placed = dense_index(rows.withColumn("__hash", stable_order(F.col(key))), "__hash", "__place").drop("__hash").crossJoin(F.broadcast(size))  # one row
    following = placed.select(*([by] if by else []), F.col("__place").alias("__next"), *[F.col(c).alias(f"other_{c}") for c in rows.columns if c != by])
    if by:
        following = following.withColumn(f"other_{by}", F.col(by))
    wanted = placed.withColumn("__next", (F.col("__place") + 1) % F.col("__size"))
    return wanted.join(following, [*([by] if by else []), "__next"]).where(F.col(key) != F.col(f"other_{key}")).drop("__place", "__next", "__size")
