"""Peak-list preprocessing on array<struct<mz, intensity>>, for spectra that already come as arrays.

operators.peaks does the same in long form; both keep one stage order: drop negatives, merge equal m/z, cut
above the precursor, relative filter, strongest N, m/z order, transform, normalise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("none", "sqrt", "log1p")


@dataclass(frozen=True)
class PeakProfile:
    min_relative_intensity: float = 0.0
    max_peaks: int | None = 128
    precursor_tolerance_da: float | None = None
    intensity_transform: str = "sqrt"
    normalize_intensity: bool = True
    remove_duplicate_mz: bool = True


#: The named profiles.
PROFILES = {
    "baseline": PeakProfile(),
    "raw": PeakProfile(max_peaks=None, intensity_transform="none"),
    "top64": PeakProfile(max_peaks=64),
    "top128": PeakProfile(max_peaks=128),
    "top256": PeakProfile(max_peaks=256),
    "intensity_1pct": PeakProfile(min_relative_intensity=0.01, max_peaks=None),
    "intensity_2pct": PeakProfile(min_relative_intensity=0.02, max_peaks=None),
    "top128_intensity_1pct": PeakProfile(min_relative_intensity=0.01, max_peaks=128),
    "precursor_plus_2": PeakProfile(precursor_tolerance_da=2.0),
}


def profile(name: str) -> PeakProfile:
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name}; known: {', '.join(PROFILES)}")
    return PROFILES[name]


def transformed(intensity: Column, kind: str) -> Column:
    """Negative intensities count as 0."""
    x = F.greatest(intensity, F.lit(0.0))
    if kind == "none":
        return intensity
    if kind == "sqrt":
        return F.sqrt(x)
    if kind == "log1p":
        return F.log1p(x)
    raise ValueError(f"unknown transform {kind}; known: {', '.join(TRANSFORMS)}")


def zipped(mzs: Column, intensities: Column) -> Column:
    """array of (mz, intensity); raises where the lengths differ or a value is not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    peaks = F.zip_with(mzs, intensities, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))
    return (
        F.when(F.size(mzs) != F.size(intensities), F.raise_error(F.lit("m/z and intensity arrays differ in length")))
        .when(F.exists(mzs, bad) | F.exists(intensities, bad), F.raise_error(F.lit("peak arrays hold a value that is not finite")))
        .otherwise(peaks)
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda in it asks for it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(peaks: Column) -> Column:
    """Peaks of exactly equal m/z as one, intensities added, in m/z order."""
    return bound(peaks, _merged)


def _merged(peaks: Column) -> Column:
    mzs = F.array_sort(F.array_distinct(F.transform(peaks, lambda p: p["mz"])))
    return F.transform(mzs, lambda m: F.struct(m.alias("mz"), F.aggregate(F.filter(peaks, lambda p: p["mz"] == m), F.lit(0.0), lambda acc, p: acc + p["intensity"]).alias("intensity")))


def strongest(peaks: Column, n: int) -> Column:
    """The n most intense peaks (of equal ones those of lower m/z), in m/z order."""
    by_intensity = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("least"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))
    return F.array_sort(F.transform(F.slice(by_intensity, 1, n), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"))))


def _largest(peaks: Column) -> Column:
    return F.array_max(F.transform(peaks, lambda p: p["intensity"]))


def preprocessed(peaks: Column, precursor: Column | None, config: PeakProfile) -> Column:
    """The whole chain on an array of (mz, intensity)."""
    if config.precursor_tolerance_da is not None and precursor is None:
        raise ValueError("this profile needs a precursor m/z")
    out = F.filter(peaks, lambda p: (p["mz"] >= 0) & (p["intensity"] >= 0))
    out = merged(out) if config.remove_duplicate_mz else F.array_sort(out)
    if config.precursor_tolerance_da is not None:
        out = F.filter(out, lambda p: p["mz"] <= precursor + config.precursor_tolerance_da)
    if config.min_relative_intensity > 0:
        out = bound(out, lambda o: bound(_largest(o), lambda top: F.filter(o, lambda p: p["intensity"] >= top * config.min_relative_intensity)))
    if config.max_peaks is not None:
        out = strongest(out, config.max_peaks)
    out = F.transform(out, lambda p: F.struct(p["mz"].alias("mz"), transformed(p["intensity"], config.intensity_transform).alias("intensity")))
    if config.normalize_intensity:
        scaled = lambda top: lambda p: F.struct(p["mz"].alias("mz"), F.when(top > 0, p["intensity"] / top).otherwise(p["intensity"]).alias("intensity"))
        out = bound(out, lambda o: bound(_largest(o), lambda top: F.transform(o, scaled(top))))
    return out
