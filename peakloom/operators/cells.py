"""Ranks and quantiles in cells: ranges of a value, cut by some of the values themselves, so that no task orders them all.

Cut points are the distinct values that a hash picks, some hundred of a group: they follow the distribution,
whatever its shape, are the same when a lost task runs again, and their number is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256
SIDE = 16  # cuts are looked up in two steps


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; without keys ``right`` is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(c).alias(f"__right_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in by])).drop(*[f"__right_{c}" for c in by])


def with_cells(values: DataFrame, column: str, by: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """``values``, one row a distinct (by, column), with __cell: it grows with ``column``; nulls are in cell 0, which holds no cut."""
    by = list(by or [])
    sizes = values.groupBy(*by).agg(F.count(column).alias("__n"))
    picked = F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.greatest(F.lit(1), F.expr(f"__n div {cells}"))) == 0)
    cuts = joined(values.select(*by, column), sizes, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.when(picked, F.col(column)))).alias("__cuts"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda c, i: i % SIDE == 0))
    at = F.size(F.filter("__coarse", lambda c: c <= F.col(column)))
    fine = F.filter(F.slice("__cuts", F.greatest(at - 1, F.lit(0)) * SIDE + 1, F.lit(SIDE)), lambda c: c <= F.col(column))
    cell = F.when(F.col(column).isNull() | (at == 0), 0).otherwise((at - 1) * SIDE + F.size(fine))
    return joined(values, cuts, by).withColumn("__cell", cell).drop("__cuts", "__coarse")


def quantiles(df: DataFrame, column: str, points: dict[str, float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., a column a point): exact, linearly interpolated. Values are counted first, and only the cells that a
    wanted rank falls in are put in order. With ``weight`` a row counts so many times."""
    by = list(by or [])
    values = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("__c"))
    celled = with_cells(values, "__v", by)
    sizes = celled.groupBy(*by, "__cell").agg(F.sum("__c").alias("__size"))  # some hundred rows a group
    bounds = sizes.withColumn("__until", F.sum("__size").over(Window.partitionBy(*by).orderBy("__cell"))).withColumn("__all", F.sum("__size").over(Window.partitionBy(*by)))
    ranks = {name: q * (F.col("__all") - 1) for name, q in points.items()}

    def meets(rank, start, end):
        return (rank >= start) & (rank < end)

    wanted = [meets(f(r), F.col("__until") - F.col("__size"), F.col("__until")) for r in ranks.values() for f in (F.floor, F.ceil)]
    cells = bounds.where(reduce(lambda a, b: a | b, wanted)).select(*by, "__cell", (F.col("__until") - F.col("__size")).alias("__before"), "__all")
    inside = joined(celled, cells, [*by, "__cell"])
    inside = inside.withColumn("__to", F.sum("__c").over(Window.partitionBy(*by, "__cell").orderBy("__v")) + F.col("__before")).withColumn("__from", F.col("__to") - F.col("__c"))
    found = [F.max(F.when(meets(f(r), F.col("__from"), F.col("__to")), F.col("__v"))).alias(f"__{side}_{name}") for name, r in ranks.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    one = inside.groupBy(*by).agg(F.max("__all").alias("__all"), *found)
    return one.select(*by, *[(F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (r - F.floor(r))).alias(name) for name, r in ranks.items()])


def aggregated(df: DataFrame, by: list[str] | None, aggregates: list, column: str, points: dict[str, float], weight: str | None = None) -> DataFrame:
    """(by..., aggregates, quantiles of ``column``): a group without a value has null quantiles."""
    by = list(by or [])
    plain, exact = df.groupBy(*by).agg(*aggregates), quantiles(df, column, points, by, weight)
    if not by:
        return plain.join(exact, F.lit(True), "left")  # one row each
    other = exact.select(*[F.col(c).alias(f"__right_{c}") for c in by], *points)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in by])
    return plain.join(other, on, "left").drop(*[f"__right_{c}" for c in by])
