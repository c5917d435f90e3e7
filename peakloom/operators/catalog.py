"""Structure catalogs: rollups, ambiguity audits, the combined index and its provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chem import error_ppm, formula_mass, mass_key, parse_formula
from ..functions.keys import joined_distinct
from .splits import first_of


def rollup(rows: DataFrame, structure: str, order: str, first: list[str], counted: dict[str, str], flags: dict[str, F.Column] | None = None) -> DataFrame:
    """One row a structure: first values by ``order``, number of rows, distinct counts, conditional counts."""
    picks = [F.min_by(c, order).alias(c) for c in first]
    distinct = [F.count_distinct(c).alias(name) for name, c in counted.items()]
    conditional = [F.count_if(cond).alias(name) for name, cond in (flags or {}).items()]
    return rows.groupBy(structure).agg(*picks, F.count("*").alias("n_rows"), *distinct, *conditional)


def ambiguity(rows: DataFrame, structure: str, name: str, formula: str, mass: str, mass_slack: float = 1e-6) -> DataFrame:
    """Distinct names, formulas and masses of each structure, the mass range, and what conflicts."""
    out = rows.groupBy(structure).agg(F.count_distinct(name).alias("n_names"), F.count_distinct(formula).alias("n_formulas"), F.count_distinct(mass).alias("n_masses"), F.min(mass).alias("min_mass"), F.max(mass).alias("max_mass"))
    return out.withColumn("mass_range", F.col("max_mass") - F.col("min_mass")).withColumn("formula_conflict", F.col("n_formulas") > 1).withColumn("mass_conflict", F.col("mass_range") > mass_slack)


def combined_index(sources: dict[str, DataFrame], structure: str = "structure", smiles: str = "smiles", mass: str = "exact_mass") -> DataFrame:
    """One row a (structure, mass at 8 decimals): the first variant by source and smiles, the sources that have
    the variant and those that have the structure, joined by '+'."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("mass_key", mass_key(F.col(mass)))
    variants = rows.groupBy(structure, "mass_key").agg(joined_distinct(F.col("source"), "+").alias("sources"))
    owners = rows.groupBy(structure).agg(joined_distinct(F.col("source"), "+").alias("structure_sources"))
    picked = first_of(rows, [structure, "mass_key"], [F.col("source"), F.col(smiles)]).drop("source")
    return picked.join(variants, [structure, "mass_key"]).join(owners, structure)


def growth(base_pool: DataFrame, combined_pool: DataFrame, group: str, candidate: str) -> DataFrame:
    """Pool sizes of each group from the base and from the combined index, candidates added and the growth factor."""
    a = base_pool.groupBy(group).agg(F.count_distinct(candidate).alias("n_base"))
    b = combined_pool.groupBy(group).agg(F.count_distinct(candidate).alias("n_combined"))
    both = b.join(a, group, "left").withColumn("n_base", F.coalesce("n_base", F.lit(0).cast("long")))
    return both.withColumn("n_added", F.col("n_combined") - F.col("n_base")).withColumn("growth", F.try_divide(F.col("n_combined"), F.col("n_base")))


def formula_consistency(rows: DataFrame, formula: str, mass: str, ppm: float = 5.0) -> DataFrame:
    """One row of counts: formulas that can't be parsed or hold an unknown element, and stored masses within and beyond ``ppm``."""
    error = F.abs(error_ppm(F.col(mass), formula_mass(F.col(formula))))
    unparsable = parse_formula(F.col(formula)).isNull()
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(unparsable).alias("n_unparsable"),
        F.count_if(~unparsable & formula_mass(F.col(formula)).isNull()).alias("n_unknown_element"),
        F.count_if(error.isNotNull()).alias("n_compared"),
        F.count_if(error <= ppm).alias(f"n_within_{ppm:g}"),
        F.count_if(error > ppm).alias(f"n_beyond_{ppm:g}"),
        F.max(error).alias("worst_ppm"),
    )
