"""Adduct, mass and formula algebra and the mass-filter policy, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ion mass shifts in dalton.
PROTON = 1.007276466621
SODIUM = 22.989218
POTASSIUM = 38.963158
AMMONIUM = 18.033823
CHLORIDE = 34.969402
FORMATE = 44.998201

#: Adduct, charge, number of molecules, mass shift, trusted for hard mass filtering.
ADDUCTS = [
    ("[M+H]+", 1, 1, PROTON, True),
    ("[M-H]-", -1, 1, -PROTON, True),
    ("[M+Na]+", 1, 1, SODIUM, True),
    ("[M+K]+", 1, 1, POTASSIUM, True),
    ("[M+NH4]+", 1, 1, AMMONIUM, True),
    ("[M+Cl]-", -1, 1, CHLORIDE, True),
    ("[M+CH2O2-H]-", -1, 1, FORMATE, True),
    ("[2M+H]+", 1, 2, PROTON, True),
    ("[2M+Na]+", 1, 2, SODIUM, True),
    ("[2M-H]-", -1, 2, -PROTON, True),
    ("[M+2H]2+", 2, 1, 2 * PROTON, False),
    ("[M-2H]2-", -2, 1, -2 * PROTON, True),
]

#: Monoisotopic masses in dalton.
ELEMENT_MASSES = {
    "H": 1.00782503223,
    "C": 12.0,
    "N": 14.00307400443,
    "O": 15.99491461957,
    "F": 18.99840316273,
    "P": 30.97376199842,
    "S": 31.9720711744,
    "Cl": 34.968852682,
    "Br": 78.9183376,
    "I": 126.904468,
    "Si": 27.97692653465,
    "B": 11.00930536,
}


@dataclass(frozen=True)
class MassPolicy:
    """Sources and tolerances of the hard-filter decision; callers give the sources that they know."""

    hard_ppm: float = 10.0
    fallback_ppm: float = 20.0
    high_confidence: tuple[str, ...] = ("pluskal_ms2", "spectraverse", "msdial")
    noisy: tuple[str, ...] = ("riken", "gnps", "massbank", "mona")
    domain_instrument: str = "timstof"


@dataclass(frozen=True)
class ChemistryConfig:
    """Which adducts a soft or hard candidate filter applies to, and its tolerance."""

    tolerance_ppm: float = 10.0
    hard_adducts: tuple[str, ...] = ("[M+H]+", "[M-H]-", "[M+CH2O2-H]-", "[M+Cl]-", "[2M+H]+", "[2M+Na]+", "[2M-H]-")
    soft_adducts: tuple[str, ...] = ("[M+Na]+", "[M+K]+", "[M+NH4]+")
    disabled_adducts: tuple[str, ...] = ("[M+2H]2+",)
    use_formula: bool = True
    require_formula: bool = True
    fallback: bool = True
    keep_best: int = 25


def adduct_table(spark: SparkSession) -> DataFrame:
    """(adduct, charge, multimer, mass_shift, trusted): twelve rows, small enough to broadcast."""
    return spark.createDataFrame(ADDUCTS, "adduct string, charge int, multimer int, mass_shift double, trusted boolean")


def with_adducts(df: DataFrame, adduct: str = "adduct") -> DataFrame:
    """``df`` with charge, multimer, mass_shift, trusted and supported; an unknown adduct has nulls and is unsupported."""
    table = adduct_table(df.sparkSession).withColumnRenamed("adduct", "__adduct")
    joined = df.join(F.broadcast(table), df[adduct] == F.col("__adduct"), "left")
    return joined.withColumn("supported", F.col("__adduct").isNotNull()).withColumn("trusted", F.coalesce("trusted", F.lit(False))).drop("__adduct")


def neutral_mass(mz: Column, charge: Column, multimer: Column, shift: Column) -> Column:
    return (mz * F.abs(charge) - shift) / multimer


def precursor_mz(mass: Column, charge: Column, multimer: Column, shift: Column) -> Column:
    return (multimer * mass + shift) / F.abs(charge)


def error_da(observed: Column, expected: Column) -> Column:
    return observed - expected


def error_ppm(observed: Column, expected: Column) -> Column:
    """Relative to ``expected``; null where that is 0."""
    return F.try_divide(observed - expected, expected) * 1e6


def hit_ppm(candidate: Column, query: Column) -> Column:
    """The range join's own convention: candidate minus query, relative to the query."""
    return F.try_divide(candidate - query, query) * 1e6


def within_ppm(observed: Column, expected: Column, tolerance: Column | float) -> Column:
    return F.abs(error_ppm(observed, expected)) <= tolerance


def tolerance_da(mass: Column, ppm: Column | float) -> Column:
    """Width in dalton; null for a mass that is not positive or a negative tolerance."""
    ppm = F.lit(ppm) if isinstance(ppm, (int, float)) else ppm
    return F.when((mass > 0) & (ppm >= 0), mass * ppm * 1e-6)


def policy_decision(supported: Column, trusted: Column, instrument: Column, source: Column, inference: Column, policy: MassPolicy | None = None) -> Column:
    """struct(hard_filter, tolerance_ppm, confidence, reason) by the ordered rules of the mass-filter policy."""
    policy = policy or MassPolicy()
    in_domain = F.lower(F.trim(F.coalesce(instrument, F.lit("")))) == policy.domain_instrument
    origin = F.trim(F.coalesce(source, F.lit("")))

    def outcome(hard: bool, ppm: float | None, confidence: str, reason: str) -> Column:
        return F.struct(F.lit(hard).alias("hard_filter"), F.lit(ppm).cast("double").alias("tolerance_ppm"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    return (
        F.when(~supported, outcome(False, None, "unsupported", "no mass conversion for this adduct"))
        .when(~trusted, outcome(False, None, "untrusted_adduct", "adduct too unreliable for a hard filter"))
        .when(inference & in_domain, outcome(True, policy.hard_ppm, "high", "instrument of the domain at inference"))
        .when(inference, outcome(True, policy.fallback_ppm, "medium", "other instrument at inference, wider window"))
        .when(origin.isin(*policy.high_confidence), outcome(True, policy.hard_ppm, "high", "source of consistent masses"))
        .when(in_domain, outcome(True, policy.hard_ppm, "high", "instrument of the domain"))
        .when(origin.isin(*policy.noisy), outcome(False, None, "low", "source of noisy masses or adducts"))
        .otherwise(outcome(False, None, "unknown", "source of unknown reliability"))
    )


def parse_formula(formula: Column) -> Column:
    """map element -> count; null for a text that is no formula. A charge at the end is left out, repeats add up."""
    body = F.regexp_replace(F.trim(formula), r"[+-]\d*$", "")
    parts = F.regexp_extract_all(body, F.lit(r"[A-Z][a-z]?\d*"), F.lit(0))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[A-Z][a-z]?", 0).alias("element"), F.coalesce(F.nullif(F.regexp_extract(p, r"\d+$", 0), F.lit("")), F.lit("1")).cast("int").alias("n")))
    elements = F.array_distinct(F.transform(pairs, lambda p: p["element"]))
    counts = F.transform(elements, lambda e: F.aggregate(F.filter(pairs, lambda p: p["element"] == e), F.lit(0), lambda acc, p: acc + p["n"]))
    return F.when(body.rlike(r"^([A-Z][a-z]?\d*)+$"), F.map_from_arrays(elements, counts))


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass; null for no formula or an unknown element."""
    masses = F.create_map(*[F.lit(x) for pair in ELEMENT_MASSES.items() for x in pair])
    return F.aggregate(F.map_entries(parse_formula(formula)), F.lit(0.0), lambda acc, e: acc + masses[e["key"]] * e["value"])


def formula_checked(formula: Column) -> Column:
    """parse_formula that raises on a text that is no formula."""
    return F.coalesce(parse_formula(formula), F.raise_error(F.concat(F.lit("no molecular formula: "), F.coalesce(formula, F.lit("null")))))


def candidate_verdict(neutral: Column, candidate_mass: Column, candidate_formula: Column, formula: Column, trusted: Column, ppm: float = 10.0, use_formula: bool = True) -> Column:
    """struct(candidate_mass, neutral_mass, error_da, error_ppm, candidate_formula, formula_match, mass_ok, formula_ok, trusted,
    accepted): an untrusted adduct passes the mass test, an unknown formula (whose formula_match is null) its own."""
    error = error_ppm(neutral, candidate_mass)
    mass_ok = ~trusted | (F.abs(error) <= ppm)
    match = F.when(formula.isNotNull(), formula.eqNullSafe(candidate_formula))
    formula_ok = F.coalesce(match, F.lit(True)) if use_formula else F.lit(True)
    fields = {"candidate_mass": candidate_mass, "neutral_mass": neutral, "error_da": error_da(neutral, candidate_mass), "error_ppm": error, "candidate_formula": candidate_formula, "formula_match": match, "mass_ok": mass_ok, "formula_ok": formula_ok, "trusted": trusted, "accepted": mass_ok & formula_ok}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def is_eligible(supported: Column, trusted: Column, instrument: Column, source: Column, precursor: Column, policy: MassPolicy | None = None) -> Column:
    """Whether a spectrum serves mass-aware training: a trusted adduct, a sound precursor, and a good source or the domain's instrument."""
    policy = policy or MassPolicy()
    in_domain = F.lower(F.trim(F.coalesce(instrument, F.lit("")))) == policy.domain_instrument
    sound = precursor.isNotNull() & ~F.isnan(precursor) & (precursor > 0) & (precursor < float("inf"))
    return supported & trusted & sound & (F.trim(F.coalesce(source, F.lit(""))).isin(*policy.high_confidence) | in_domain)


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A finite double, or ``default``."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def availability(supporting: Column, total: Column) -> Column:
    """supporting / total within [0, 1]; 0 where there is no total."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), supporting / total))).otherwise(F.lit(0.0))


def reciprocal_rank(rank: Column) -> Column:
    """1 / rank; 0 for null, zero and negative ranks."""
    return F.when(rank > 0, F.lit(1.0) / rank).otherwise(F.lit(0.0))


def mass_key(mass: Column) -> Column:
    """Mass at 8 decimals, half to even."""
    return F.bround(mass, 8)


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, floor: float = 0.0) -> Column:
    """Learning rate: linear up to ``peak`` over ``warmup`` steps, then a half cosine down to ``floor``."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.pi() * share)))
