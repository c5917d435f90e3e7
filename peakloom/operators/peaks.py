"""Peak lists in long form: one row a (spectrum, m/z, intensity). Every stage is a filter, a grouping or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peak_arrays import PeakProfile, transformed

BIN_WIDTH, MIN_MZ, MAX_MZ = 0.1, 0.0, 1000.0


def preprocess(peaks: DataFrame, config: PeakProfile, spectrum: str = "spectrum_id", precursor: str | None = None) -> DataFrame:
    """(spectrum, mz, intensity) after: no negatives, equal m/z merged, cut above the precursor, relative filter
    (against the largest intensity that is left by then), strongest N (ties by lower m/z), transform, normalise."""
    if config.precursor_tolerance_da is not None and precursor is None:
        raise ValueError("this profile needs a precursor column")
    kept = [spectrum] + ([precursor] if precursor else [])
    rows = peaks.where("mz >= 0 and intensity >= 0").select(*kept, "mz", "intensity")
    if config.remove_duplicate_mz:
        rows = rows.groupBy(*kept, "mz").agg(F.sum("intensity").alias("intensity"))
    if config.precursor_tolerance_da is not None:
        rows = rows.where(F.col("mz") <= F.col(precursor) + config.precursor_tolerance_da)
    whole = Window.partitionBy(spectrum)
    if config.min_relative_intensity > 0:
        rows = rows.withColumn("__top", F.max("intensity").over(whole)).where(F.col("intensity") >= F.col("__top") * config.min_relative_intensity).drop("__top")
    if config.max_peaks is not None:
        strongest = Window.partitionBy(spectrum).orderBy(F.desc("intensity"), "mz")
        rows = rows.withColumn("__n", F.row_number().over(strongest)).where(F.col("__n") <= config.max_peaks).drop("__n")
    rows = rows.withColumn("intensity", transformed(F.col("intensity"), config.intensity_transform))
    if config.normalize_intensity:
        top = F.max("intensity").over(whole)
        rows = rows.withColumn("intensity", F.when(top > 0, F.col("intensity") / top).otherwise(F.col("intensity")))
    return rows.select(spectrum, "mz", "intensity")


def mz_bin(mz: Column, width: float | Column = BIN_WIDTH, low: float = MIN_MZ) -> Column:
    return F.floor((mz - low) / width)


def sparse_bins(peaks: DataFrame, width: float = BIN_WIDTH, low: float = MIN_MZ, high: float = MAX_MZ, spectrum: str = "spectrum_id") -> DataFrame:
    """(spectrum, bin, v): intensities added in bins of m/z in [low, high); values that aren't finite or positive are left out."""
    fine = ~F.isnan("mz") & ~F.isnan("intensity") & (F.abs("intensity") < float("inf")) & (F.col("intensity") > 0) & (F.col("mz") >= low) & (F.col("mz") < high)
    return peaks.where(fine).groupBy(spectrum, mz_bin(F.col("mz"), width, low).alias("bin")).agg(F.sum("intensity").alias("v"))


def norms(bins: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    return bins.groupBy(spectrum).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def normalized(bins: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """Bins over their spectrum's norm; a zero spectrum has none."""
    return bins.join(norms(bins, spectrum), spectrum).where("norm > 0").select(spectrum, "bin", (F.col("v") / F.col("norm")).alias("v"))


def integrity(peaks: DataFrame, precursor: str = "precursor_mz") -> DataFrame:
    """One row of counts over array spectra (mzs, intensities, precursor): what breaks a peak list's rules."""
    mzs, ints = F.col("mzs"), F.col("intensities")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return peaks.agg(
        F.count("*").alias("n_spectra"),
        F.count_if(F.size(mzs) != F.size(ints)).alias("n_length_mismatch"),
        F.count_if(mzs != F.array_sort(mzs)).alias("n_unsorted"),
        F.count_if(F.exists(mzs, odd) | F.exists(ints, odd)).alias("n_not_finite"),
        F.count_if(F.exists(mzs, lambda x: x < 0) | F.exists(ints, lambda x: x < 0)).alias("n_negative"),
        F.count_if(F.exists(ints, lambda x: (x > 1 + 1e-9) & ~F.isnan(x))).alias("n_above_one"),
        F.count_if(F.size(F.array_distinct(mzs)) < F.size(mzs)).alias("n_duplicate_mz"),
        F.count_if(F.exists(mzs, lambda x: (x > F.col(precursor) + 2) & ~F.isnan(x))).alias("n_above_precursor"),
    )


def reduction(before: DataFrame, after: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """One row: spectra, mean peaks before and after, percent of peaks removed, spectra that are left without a peak."""
    a = before.groupBy(spectrum).agg(F.count("*").alias("__a"))
    z = after.groupBy(spectrum).agg(F.count("*").alias("__z"))
    both = a.join(z, spectrum, "left").withColumn("__z", F.coalesce("__z", F.lit(0).cast("long")))
    return both.agg(
        F.count("*").alias("n_spectra"),
        F.avg("__a").alias("mean_before"),
        F.avg("__z").alias("mean_after"),
        (100.0 * (1 - F.try_divide(F.sum("__z"), F.sum("__a")))).alias("percent_removed"),
        F.count_if(F.col("__z") == 0).alias("n_empty"),
    )
