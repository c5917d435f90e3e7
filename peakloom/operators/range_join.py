"""Tolerance join of query masses to candidate masses, and what is built on it.

A plain range condition would be a nested-loop join. Here both sides get buckets on the logarithm of the mass, as wide as
the widest window of equal ppm, which is so at every mass: a candidate lies in one bucket, a query's window in one to
three, and the bucket is an equi-join key. The range condition stays exact, and no pair can come twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chem import MassPolicy, hit_ppm, neutral_mass, policy_decision, tolerance_da


def clean_variants(variants: DataFrame, mass: str = "exact_mass", structure: str = "structure") -> DataFrame:
    """Rows with a key and a finite positive mass; texts are tried as numbers."""
    x = F.col(mass).cast("string").try_cast("double")
    return variants.withColumn(mass, x).where(F.col(structure).isNotNull() & F.col(mass).isNotNull() & ~F.isnan(mass) & (F.col(mass) > 0) & (F.col(mass) < float("inf")))


def log_bucket(mass: Column, step: float, nudge: float = 0.0) -> Column:
    """Place of a mass among buckets of relative width ``step``; grows with the mass, and is defined for any number."""
    return F.floor(F.asinh(mass * 1000) / step + nudge)


def bucket_step(ppm: float | Column, widest_ppm: float | None = None) -> float:
    return max(1e-9, 2e-6 * (widest_ppm if widest_ppm is not None else ppm if isinstance(ppm, (int, float)) else 20.0))


def windows(queries: DataFrame, ppm: float | Column, mass: str, step: float) -> DataFrame:
    """``queries`` with __low, __high and a row for each bucket that the window meets; a mass or tolerance without a window has none."""
    if isinstance(ppm, (int, float)) and ppm < 0:
        raise ValueError("the tolerance must not be negative")
    half = tolerance_da(F.col(mass), ppm)
    asked = queries.withColumn("__low", F.col(mass) - half).withColumn("__high", F.col(mass) + half).where(F.col("__low").isNotNull())
    # the nudge takes in a bound that rounding could put into the next bucket
    return asked.withColumn("__bucket", F.explode(F.sequence(log_bucket(F.col("__low"), step, -1e-6), log_bucket(F.col("__high"), step, 1e-6))))


def tolerance_join(queries: DataFrame, candidates: DataFrame, ppm: float | Column, mass: str = "mass", candidate_mass: str = "exact_mass", widest_ppm: float | None = None) -> DataFrame:
    """Every (query, candidate) with the candidate's mass in the closed window of ``ppm`` around the query's.

    ``widest_ppm`` only sets the bucket width: windows beyond it are still complete, as a window is exploded to all
    the buckets that it meets.
    """
    step = bucket_step(ppm, widest_ppm)
    right = candidates.withColumn("__bucket", log_bucket(F.col(candidate_mass), step))
    joined = windows(queries, ppm, mass, step).join(right, "__bucket").where(F.col(candidate_mass).between(F.col("__low"), F.col("__high")))
    return joined.drop("__bucket", "__low", "__high")


def with_neighbours(variants: DataFrame) -> DataFrame:
    """One row a (structure, exact_mass), the first by smiles, with the structure's variant_count over all its rows and the
    masses of its next lighter and next heavier variant."""
    whole, same = Window.partitionBy("structure"), Window.partitionBy("structure", "exact_mass").orderBy("smiles")
    counted = variants.where("structure is not null and exact_mass is not null").repartition("structure")
    first = counted.withColumn("variant_count", F.count("*").over(whole)).withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    by_mass = whole.orderBy("exact_mass")
    return first.withColumn("__lighter", F.lag("exact_mass").over(by_mass)).withColumn("__heavier", F.lead("exact_mass").over(by_mass))


def nearest_hits(queries: DataFrame, variants: DataFrame, ppm: float | Column, mass: str = "mass", **widths: float) -> DataFrame:
    """Each query's nearest variant of each structure in its window, once, with error_ppm and variant_count.

    A variant is the nearest if its neighbours of the same structure are not nearer, so the join itself picks it
    and the hits need no shuffle. Of equally near variants the lighter one counts, then the first by smiles.
    """
    return nearest_only(tolerance_join(queries, with_neighbours(variants), ppm, mass, **widths), mass)


def nearest_only(hits: DataFrame, mass: str = "mass") -> DataFrame:
    """``nearest_hits`` of joined rows of ``with_neighbours``."""

    def size(candidate: str) -> Column:
        return F.abs(hit_ppm(F.col(candidate), F.col(mass)))

    nearest = (F.col("__lighter").isNull() | (size("exact_mass") < size("__lighter"))) & (F.col("__heavier").isNull() | (size("exact_mass") <= size("__heavier")))
    return hits.where(nearest).drop("__lighter", "__heavier").withColumn("error_ppm", hit_ppm(F.col("exact_mass"), F.col(mass)))


def mass_hits(queries: DataFrame, variants: DataFrame, ppm: float | Column, query: str = "spectrum_id", mass: str = "mass", max_candidates: int | None = None, **widths: float) -> DataFrame:
    """One row a query and structure: its nearest variant, the errors and the structure's variant count.

    ``variants`` has structure, exact_mass and smiles. ``max_candidates`` keeps a query's nearest structures, ties
    by structure.
    """
    if max_candidates is not None and max_candidates <= 0:
        raise ValueError("max_candidates must be positive")
    best = nearest_hits(queries, variants, ppm, mass, **widths).withColumn("error_da", F.col("exact_mass") - F.col(mass))
    if max_candidates is None:
        return best
    by_query = Window.partitionBy(query).orderBy(F.abs("error_ppm"), "structure")
    return best.withColumn("__n", F.row_number().over(by_query)).where(F.col("__n") <= max_candidates).drop("__n")


def hit_counts(queries: DataFrame, variants: DataFrame, ppm: float | Column, query: str = "spectrum_id", mass: str = "mass", **widths: float) -> DataFrame:
    """(query, n_candidates) for every query, those without a hit included. A mass is asked once, for all of its queries."""
    from .mass_classes import counted

    fixed = isinstance(ppm, (int, float))
    each = queries.select(F.col(query).alias("__query"), F.col(mass).alias("__mass"), *([] if fixed else [ppm.alias("__ppm")]))
    asked = each.columns[1:]
    slim = with_neighbours(variants.select("structure", "exact_mass", F.lit("").alias("smiles")))
    counts = counted(each.select(*asked).distinct(), slim, ppm if fixed else F.col("__ppm"), "__mass", **widths)
    found = each.join(counts, asked, "left").repartition("__query").groupBy("__query", *asked).agg(F.max("n_candidates").alias("n"))
    return found.groupBy(F.col("__query").alias(query)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_candidates"))


def guarded(spectra: DataFrame, require_trusted: bool = True) -> DataFrame:
    """``spectra`` (with supported, trusted, mass) and their ``status``: unsupported, untrusted, bad_mass or ok."""
    bad = F.col("mass").isNull() | F.isnan("mass") | (F.col("mass") <= 0)
    status = F.when(~F.col("supported"), "unsupported").when(F.lit(require_trusted) & ~F.col("trusted"), "untrusted").when(bad, "bad_mass").otherwise("ok")
    return spectra.withColumn("status", status)


def generate_candidates(spectra: DataFrame, variants: DataFrame, ppm: float | Column, require_trusted: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(status a spectrum, hits of those that are ok)."""
    status = guarded(spectra, require_trusted)
    return status, mass_hits(status.where("status = 'ok'"), variants, ppm, **options)


def decided_by_policy(spectra: DataFrame, inference: bool, policy: MassPolicy | None = None) -> DataFrame:
    """``spectra`` (precursor_mz, the adduct's columns, instrument, source) with neutral mass, status and decision."""
    mass = neutral_mass(F.col("precursor_mz"), F.col("charge"), F.col("multimer"), F.col("mass_shift"))
    decision = policy_decision(F.col("supported"), F.col("trusted"), F.col("instrument"), F.col("source"), F.lit(inference), policy or MassPolicy())
    return guarded(spectra.withColumn("mass", mass)).withColumn("decision", decision)


def generate_by_policy(spectra: DataFrame, variants: DataFrame, inference: bool, policy: MassPolicy | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(spectra with neutral mass, status and decision, hits of those that the policy filters hard, each by its own tolerance).

    ``spectra`` has precursor_mz, the adduct's columns (``with_adducts``), instrument and source.
    """
    policy = policy or MassPolicy()
    decided = decided_by_policy(spectra, inference, policy)
    asked = decided.where("status = 'ok' and decision.hard_filter").withColumn("tolerance_ppm", F.col("decision.tolerance_ppm"))
    return decided, mass_hits(asked, variants, F.col("tolerance_ppm"), widest_ppm=max(policy.hard_ppm, policy.fallback_ppm), **options)
