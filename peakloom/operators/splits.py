"""Deterministic splits, capped picks and first-of-group choices. Random draws are replaced by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import assign_split, stable_fraction, stable_order
from .cells import CELLS, with_cells


def structure_split(structures: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    return structures.withColumn("split", assign_split(F.col(key).cast("string"), share))


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def capped(df: DataFrame, by: list[str], order: list[Column], most: int | Column) -> DataFrame:
    """The first ``most`` rows of each key, with their place."""
    most = F.lit(most) if isinstance(most, int) else most
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def library_split(rows: DataFrame, structure: str, row: str, preferred: Column) -> DataFrame:
    """``role``: of structures with two rows or more one row is the query (a preferred one if any, then by hash), the rest references; lone rows are unused."""
    w = Window.partitionBy(structure)
    order = w.orderBy(F.desc(preferred.cast("int")), stable_order(F.col(structure), F.col(row)), row)
    marked = rows.withColumn("__n", F.row_number().over(order)).withColumn("__size", F.count("*").over(w))
    return marked.withColumn("role", F.when(F.col("__size") < 2, "unused").when(F.col("__n") == 1, "query").otherwise("reference")).drop("__n", "__size")


def multispectrum_split(rows: DataFrame, structure: str, row: str, preferred: Column, most: int = 3, least_rows: int = 3, least_preferred: int = 2) -> DataFrame:
    """``role`` of eligible structures' rows: min(most, preferred rows, rows - 1) preferred ones are queries, the rest references."""
    w = Window.partitionBy(structure)
    counted = rows.withColumn("__rows", F.count("*").over(w)).withColumn("__good", F.count_if(preferred).over(w)).where((F.col("__rows") >= least_rows) & (F.col("__good") >= least_preferred))
    order = w.orderBy(F.desc(preferred.cast("int")), stable_order(F.col(structure), F.col(row)), row)
    n = F.least(F.lit(most), F.col("__good"), F.col("__rows") - 1)
    return counted.withColumn("__n", F.row_number().over(order)).withColumn("role", F.when(F.col("__n") <= n, "query").otherwise("reference")).drop("__n", "__rows", "__good")


def grouped_split(rows: DataFrame, molecule: str, share: float = 0.2) -> DataFrame:
    """Molecule-disjoint: the first round(share * n) molecules in hash order are validation.

    The place is counted in two levels (256 ranges of the hash, then inside each), so no task sorts all molecules.
    """
    fraction = stable_fraction(F.col(molecule).cast("string"))
    names = rows.select(molecule).distinct().withColumn("__f", fraction).withColumn("__cell", F.floor(F.col("__f") * 256))
    cells = names.groupBy("__cell").agg(F.count("*").alias("__size"))
    before = cells.select("__cell", F.coalesce(F.sum("__size").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__size").over(Window.partitionBy()).alias("__all"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy("__f", molecule))
    placed = names.withColumn("__n", inside).join(F.broadcast(before), "__cell")  # 256 rows at most
    split = placed.select(molecule, F.when(F.col("__n") + F.col("__before") <= F.bround(share * F.col("__all")), "validation").otherwise("train").alias("split"))
    return rows.join(split, molecule)


def drawn_size(key: Column, sizes: list[int]) -> Column:
    """A group size from the given distribution by a hashed uniform (inverse distribution function)."""
    ordered = sorted(sizes)
    return F.element_at(F.array(*[F.lit(s) for s in ordered]), (F.floor(stable_fraction(key) * len(ordered)) + 1).cast("int"))


def dense_index(df: DataFrame, key: str, name: str = "row_index", cells: int = CELLS) -> DataFrame:
    """0, 1, 2, ... in the order of a unique key, counted by ranges of it, so that no task holds all keys; a null key is first.

    The ranges are cut by keys that a hash picks, so they follow the keys' distribution, and a lost task that is
    run again places its rows alike.
    """
    placed = with_cells(df, key, cells=cells)
    sizes = placed.groupBy("__cell").agg(F.count("*").alias("__size"))
    before = sizes.select("__cell", F.coalesce(F.sum("__size").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(key))
    return placed.withColumn("__n", inside).join(before, "__cell").withColumn(name, F.col("__n") + F.col("__before") - 1).drop("__n", "__before", "__cell")


def complete_groups(rows: DataFrame, group: str, bound: int) -> DataFrame:
    """The rows of the groups that lie wholly in the first ``bound`` rows by group: a bounded head without a cut group.

    Rows are counted by group, and the running count in cells of the group's key.
    """
    placed = with_cells(rows.groupBy(group).agg(F.count("*").alias("__rows")), group)
    cells = placed.groupBy("__cell").agg(F.sum("__rows").alias("__size"))
    before = cells.select("__cell", F.coalesce(F.sum("__size").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    until = F.sum("__rows").over(Window.partitionBy("__cell").orderBy(group)) + F.col("__before")
    kept = placed.join(before, "__cell").withColumn("__until", until).where(F.col("__until") <= bound)
    return rows.join(kept.select(group), group, "left_semi")


def is_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()
