"""Queries over masses: scalar algebra, policy, range join, pools, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chem, keys
from ..operators import catalog, cells, mass_classes, mass_index, pools, profiling, range_join
from . import bindings as b
from .bindings import PPM, query, rounded, sql

HIT = "round(error_da, 6) AS error_da, round(error_ppm, 6) AS error_ppm"


@query(sql("hits", f"SELECT spectrum_id, structure, round(exact_mass, 6) AS exact_mass, smiles, variant_count, {HIT} FROM hits"))
def range_join_hits(spark, d):
    rows = b.class_hits(spark, d, shown=("structure", "smiles"))
    return mass_classes.pairs(rounded(rows), "exact_mass", "variant_count", "error_da", "error_ppm").select("spectrum_id", "structure", "exact_mass", "smiles", "variant_count", "error_da", "error_ppm")


@query(sql("hits", f"SELECT spectrum_id, structure, {HIT} FROM hits QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(error_ppm), structure) <= 2"))
def range_join_capped(spark, d):
    """The two nearest structures of each spectrum; spectra of one mass have the same."""
    near = mass_classes.nearest_lists(b.class_hits(spark, d), ["mass"], lambda m: F.struct(F.abs("error_ppm").alias("size"), m["structure"].alias("structure"), F.round("error_da", 6).alias("error_da"), F.round("error_ppm", 6).alias("error_ppm")), 2)
    return mass_classes.ranked_pairs(near, "place").select("spectrum_id", "structure", "error_da", "error_ppm")


@query(sql("spectra all_hits", "SELECT s.spectrum_id, count(DISTINCT h.structure) AS n_candidates FROM spectra s LEFT JOIN all_hits h USING (spectrum_id) GROUP BY 1"))
def range_join_counts(spark, d):
    return range_join.hit_counts(b.spectra(spark, d), b.variants(spark, d), PPM)


@query(sql("spectra all_hits", "SELECT count(*) AS n, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM (SELECT count(DISTINCT h.structure) AS n FROM spectra s LEFT JOIN all_hits h USING (spectrum_id) GROUP BY s.spectrum_id)"))
def candidate_count_distribution(spark, d):
    masses = b.weighted_masses(b.spectra(spark, d))
    return rounded(profiling.distribution(_counts(spark, d, masses), "n_candidates", weight="weight"))


def _counts(spark, d, masses):
    """``masses``, each once, with n_candidates, 0 for those without one."""
    counts = mass_classes.counted(masses.select("mass").distinct(), range_join.with_neighbours(b.variants(spark, d)), PPM)
    return masses.join(counts, "mass", "left").fillna(0, ["n_candidates"])


@query(sql("variants", "SELECT structure, round(exact_mass, 6) AS exact_mass, smiles, formula FROM variants WHERE structure IS NOT NULL AND exact_mass > 0"))
def variant_cleaning(spark, d):
    return rounded(range_join.clean_variants(b.variants(spark, d)))


@query(sql("ions", "SELECT spectrum_id, adduct, supported, trusted, round((mz * abs(charge) - mass_shift) / multimer, 6) AS neutral_mass, round(mz, 6) AS mz FROM ions"))
def adduct_roundtrip(spark, d):
    mass = chem.neutral_mass(F.col("mz"), F.col("charge"), F.col("multimer"), F.col("mass_shift"))
    return rounded(b.ions(spark, d).select("spectrum_id", "adduct", "supported", "trusted", mass.alias("neutral_mass"), "mz"))


@query(sql("hits", "SELECT spectrum_id, structure, round((exact_mass - mass) / mass * 1e6, 6) AS hit_ppm, round((mass - exact_mass) / exact_mass * 1e6, 6) AS chemistry_ppm, abs((mass - exact_mass) / exact_mass * 1e6) <= 100 AS within FROM hits"))
def ppm_both_conventions(spark, d):
    mass, exact = F.col("mass"), F.col("exact_mass")
    both = {"hit_ppm": chem.hit_ppm(exact, mass), "chemistry_ppm": chem.error_ppm(mass, exact), "within": chem.within_ppm(mass, exact, 100.0)}
    return mass_classes.pairs(rounded(b.class_hits(spark, d).withColumns(both)), *both).select("spectrum_id", "structure", *both)


@query(sql("variants", "SELECT structure, smiles, round(exact_mass * 10 * 1e-6, 8) AS width_10, round(round_even(exact_mass, 8), 8) AS mass_key FROM variants"))
def mass_tolerances(spark, d):
    return b.variants(spark, d).select("structure", "smiles", F.round(chem.tolerance_da(F.col("exact_mass"), 10.0), 8).alias("width_10"), F.round(chem.mass_key(F.col("exact_mass")), 8).alias("mass_key"))


_SOURCES = ("pluskal_ms2", "gnps", "riken", "elsewhere", "msdial")
_LIB = "CASE lib WHEN 0 THEN 'pluskal_ms2' WHEN 1 THEN 'gnps' WHEN 2 THEN 'riken' WHEN 3 THEN 'elsewhere' ELSE 'msdial' END"
_POLICY = f"SELECT spectrum_id, CASE WHEN NOT supported THEN 'unsupported' WHEN NOT trusted THEN 'untrusted_adduct' WHEN inference AND tims THEN 'high' WHEN inference THEN 'medium' WHEN source IN ('pluskal_ms2', 'spectraverse', 'msdial') OR tims THEN 'high' WHEN source IN ('riken', 'gnps', 'massbank', 'mona') THEN 'low' ELSE 'unknown' END AS confidence, supported AND trusted AND (inference OR tims OR source IN ('pluskal_ms2', 'spectraverse', 'msdial')) AS hard_filter, inference, tims, source FROM (SELECT spectrum_id, supported, trusted, {_LIB} AS source, spectrum_id % 2 = 0 AS inference, instrument = 'click' AS tims FROM ions)"


@query(sql("ions", f"SELECT spectrum_id, confidence, hard_filter, CASE WHEN hard_filter THEN CASE WHEN confidence = 'medium' THEN 20e0 ELSE 10e0 END END AS tolerance_ppm, CASE confidence WHEN 'unsupported' THEN 'no mass conversion for this adduct' WHEN 'untrusted_adduct' THEN 'adduct too unreliable for a hard filter' WHEN 'medium' THEN 'other instrument at inference, wider window' WHEN 'low' THEN 'source of noisy masses or adducts' WHEN 'unknown' THEN 'source of unknown reliability' ELSE CASE WHEN inference THEN 'instrument of the domain at inference' WHEN source IN ('pluskal_ms2', 'spectraverse', 'msdial') THEN 'source of consistent masses' ELSE 'instrument of the domain' END END AS reason FROM ({_POLICY})"))
def mass_filter_policy(spark, d):
    source = F.get(F.array(*[F.lit(s) for s in _SOURCES]), F.col("lib").cast("int"))
    instrument = F.when(F.col("instrument") == "click", " timsTOF ").otherwise("qtof")
    x = b.ions(spark, d).withColumn("p", chem.policy_decision(F.col("supported"), F.col("trusted"), instrument, source, F.col("spectrum_id") % 2 == 0))
    return x.select("spectrum_id", "p.confidence", "p.hard_filter", "p.tolerance_ppm", "p.reason")


@query(sql("ions", f"SELECT count(*) AS n_eligible FROM ions WHERE supported AND trusted AND (({_LIB}) IN ('pluskal_ms2', 'msdial') OR instrument = 'click') AND mz > 0"))
def eligible_spectra(spark, d):
    source = F.get(F.array(*[F.lit(s) for s in _SOURCES]), F.col("lib").cast("int"))
    rows = b.ions(spark, d).withColumn("source", source).withColumn("instrument", F.when(F.col("instrument") == "click", " timsTOF ").otherwise("qtof"))
    return rows.where(chem.is_eligible(F.col("supported"), F.col("trusted"), F.col("instrument"), F.col("source"), F.col("mz"))).agg(F.count("*").alias("n_eligible"))


@query(sql("ions all_hits", "SELECT i.adduct, count(*) AS n, count_if(n_hits > 0)::BIGINT AS n_survived, count_if(n_hits = 0)::BIGINT AS n_zero, round(median(n_hits), 6) AS median_hits, round(avg(n_hits), 6) AS mean_hits FROM (SELECT i.spectrum_id, i.adduct, count(DISTINCT h.structure) AS n_hits FROM ions i LEFT JOIN all_hits h USING (spectrum_id) WHERE i.supported AND i.trusted GROUP BY 1, 2) i GROUP BY 1"))
def survival_by_adduct(spark, d):
    ok = b.ions(spark, d).where("supported and trusted")
    counts = _counts(spark, d, b.weighted_masses(ok, "adduct"))
    n, w = F.col("n_candidates"), F.col("weight")
    plain = [F.sum(w).alias("n"), F.sum(F.when(n > 0, w).otherwise(0)).alias("n_survived"), F.sum(F.when(n == 0, w).otherwise(0)).alias("n_zero"), profiling.weighted_mean(n, "weight").alias("mean_hits")]
    return rounded(cells.aggregated(counts, ["adduct"], plain, "n_candidates", {"median_hits": 0.5}, "weight"))


@query(sql("ions", "SELECT CASE WHEN NOT supported THEN 'unsupported' WHEN NOT trusted THEN 'untrusted' WHEN mz IS NULL OR mass <= 0 THEN 'bad_mass' ELSE 'ok' END AS status, count(*) AS n FROM ions GROUP BY 1"))
def generation_status(spark, d):
    return range_join.guarded(b.ions(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(sql("spectra variants", "SELECT t.tolerance, count(DISTINCT s.spectrum_id) AS n_survived, count(DISTINCT (s.spectrum_id, v.structure)) AS n_pairs FROM (VALUES (50e0), (150e0), (250e0)) t(tolerance), spectra s JOIN variants v ON v.exact_mass BETWEEN s.mass - s.mass * t.tolerance * 1e-6 AND s.mass + s.mass * t.tolerance * 1e-6 GROUP BY 1"))
def survival_sweep(spark, d):
    """A spectrum's hits depend on its mass alone, so each mass is asked once, for all of its spectra."""
    masses = b.spectra(spark, d).groupBy("mass").agg(F.count_distinct("spectrum_id").alias("n"))
    each = masses.withColumn("tolerance", F.explode(F.array(F.lit(50.0), F.lit(150.0), F.lit(250.0))))
    owned = b.variants(spark, d).select("structure", "exact_mass").distinct()
    hits = range_join.tolerance_join(each, owned, F.col("tolerance"), widest_ppm=250.0)
    counts = hits.groupBy("tolerance", "mass", "n").agg(F.count_distinct("structure").alias("n_structures"))
    return counts.groupBy("tolerance").agg(F.sum("n").alias("n_survived"), F.sum(F.col("n") * F.col("n_structures")).alias("n_pairs"))


@query(sql("hits", "SELECT tolerance, round(avg((abs(error_ppm) <= tolerance)::INT), 6) AS share FROM hits, (VALUES (2e0), (5e0), (10e0), (20e0), (50e0), (90e0)) t(tolerance) GROUP BY 1"))
def tolerance_sweep(spark, d):
    hits = b.weighted_hits(spark, d, b.weighted_masses(b.spectra(spark, d)))
    return rounded(profiling.tolerance_sweep(hits, "error_ppm", [2, 5, 10, 20, 50, 90], weight="weight"))


@query(sql("measured", "SELECT adduct, round(median(shift), 6) AS shift, round(median(shift) FILTER (abs(ppm) <= 10), 6) AS shift_near, count(*) AS n, count_if(abs(ppm) <= 10)::BIGINT AS n_near FROM (SELECT adduct, mz * abs(charge) - multimer * e AS shift, (neutral - e) / e * 1e6 AS ppm FROM (SELECT *, 900e0 + (grp % 1000) / 10e0 AS e FROM measured WHERE supported)) GROUP BY 1"))
def adduct_shift(spark, d):
    """Empirical mass shift of each adduct against the expected masses: over all spectra, and over those within 10 ppm."""
    from ..functions.chem import neutral_mass

    expected = F.expr("900D + (grp % 1000) / 10D")
    rows = b.unknown(spark, d).where("supported").withColumn("expected", expected)
    rows = rows.withColumn("shift", F.col("precursor_mz") * F.abs("charge") - F.col("multimer") * F.col("expected"))
    ppm = chem.error_ppm(neutral_mass(F.col("precursor_mz"), F.col("charge"), F.col("multimer"), F.col("mass_shift")), F.col("expected"))
    near = F.abs(ppm) <= 10
    rows = rows.withColumn("near", F.when(near, F.col("shift")))
    whole = cells.aggregated(rows, ["adduct"], [F.count("*").alias("n"), F.count("near").alias("n_near")], "shift", {"shift": 0.5})
    return rounded(whole.join(cells.quantiles(rows, "near", {"shift_near": 0.5}, ["adduct"]), "adduct", "left"))


@query(sql("hits spectra", "SELECT lib, instrument, count(*) AS n, round(median(abs(error_ppm)), 6) AS median, round(quantile_cont(abs(error_ppm), 0.9), 6) AS p90, round(quantile_cont(abs(error_ppm), 0.99), 6) AS p99, round(avg((abs(error_ppm) <= 50)::INT), 6) AS within_50 FROM hits JOIN spectra USING (spectrum_id) GROUP BY GROUPING SETS ((lib), (instrument), (lib, instrument)) HAVING count(*) >= 100"))
def error_by_source(spark, d):
    """Spectra are counted by mass, source and instrument first; a hit of a mass counts for all of them."""
    none = F.lit(None)
    rows = b.weighted_hits(spark, d, b.spectra(spark, d).groupBy("mass", "lib", "instrument").agg(F.count("*").alias("weight")))
    each = rows.groupBy("lib", "instrument", F.abs("error_ppm").alias("size")).agg(F.sum("weight").alias("weight"))
    strata = F.array(F.struct("lib", none.cast("string").alias("instrument")), F.struct(none.cast("long").alias("lib"), "instrument"), F.struct("lib", "instrument"))
    each = each.select("size", "weight", F.explode(strata).alias("s")).select("size", "weight", "s.lib", "s.instrument")
    plain = [F.sum("weight").alias("n"), profiling.weighted_mean((F.col("size") <= 50).cast("double"), "weight").alias("within_50")]
    return rounded(cells.aggregated(each, ["lib", "instrument"], plain, "size", {"median": 0.5, "p90": 0.9, "p99": 0.99}, "weight").where("n >= 100"))


@query(sql("hits", "SELECT DISTINCT grp, structure FROM hits"))
def pool_union(spark, d):
    groups, _, hits = b.shared_hits(spark, d)
    return pools.for_all(pools.union(hits), groups)


@query(sql("support", "SELECT grp, structure FROM support WHERE n_supporting = n_spectra"))
def pool_intersection(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    return pools.for_all(pools.intersection(hits, asked), groups)


@query(sql("pool", "SELECT grp, structure, mode, n_supporting, n_spectra FROM pool"))
def pool_select_library(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    return pools.for_all(pools.select_pool(hits, asked).select("grp", "structure", "mode", "n_supporting", "n_spectra"), groups)


@query(sql("hits", "SELECT grp, structure, CASE WHEN any_full THEN 'intersection' ELSE 'union_fallback' END AS mode, n_supporting, n_spectra FROM (SELECT *, bool_or(n_supporting = n_spectra) OVER (PARTITION BY grp) AS any_full FROM (SELECT grp, structure, count(DISTINCT spectrum_id) AS n_supporting, any_value(n) AS n_spectra FROM hits JOIN (SELECT grp, count(DISTINCT spectrum_id) AS n FROM hits GROUP BY grp) USING (grp) GROUP BY 1, 2)) WHERE n_supporting = n_spectra OR NOT any_full"))
def pool_select_inference(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    return pools.for_all(pools.select_pool(hits, asked, ignore_empty=True).select("grp", "structure", "mode", "n_supporting", "n_spectra"), groups)


@query(sql("pool spectra", "SELECT p.grp, s.spectrum_id, p.structure, h.structure IS NOT NULL AS available FROM pool p JOIN spectra s ON s.grp = p.grp LEFT JOIN hits h ON h.spectrum_id = s.spectrum_id AND h.structure = p.structure"))
def availability_mask(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    return pools.mask_for_all(pools.pool_mask(hits, asked), groups)


@query(sql("support", "SELECT threshold, mode, count(*) AS n_candidates, count(DISTINCT grp) AS n_groups FROM (SELECT t.threshold, s.*, CASE WHEN n_full >= t.threshold THEN 'intersection' ELSE 'union' END AS mode FROM (SELECT *, count_if(n_supporting = n_spectra) OVER (PARTITION BY grp) AS n_full FROM support) s, (VALUES (1), (2), (3)) t(threshold)) WHERE mode = 'union' OR n_supporting = n_spectra GROUP BY 1, 2"))
def hybrid_sweep(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    sizes = pools.threshold_pool(hits, asked, [1, 2, 3]).groupBy("threshold", "grp", "mode").agg(F.count("*").alias("n"))
    return pools.for_all(sizes, groups).groupBy("threshold", "mode").agg(F.sum("n").alias("n_candidates"), F.count("*").alias("n_groups"))


_MANIFEST = "SELECT p.grp, p.structure, p.mode, p.n_spectra, count(DISTINCT h.spectrum_id) AS n_supporting, round(avg(h.error_ppm), 6) AS mean_error_ppm, round(avg(abs(h.error_ppm)), 6) AS mean_abs_error_ppm FROM pool p JOIN hits h ON h.grp = p.grp AND h.structure = p.structure GROUP BY ALL"


def manifest(hits, spectra):
    rows = pools.pool_summary(hits, spectra)
    return rows.select("grp", "structure", "mode", "n_spectra", "n_supporting", "mean_error_ppm", "mean_abs_error_ppm")


@query(sql("pool", f"SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n_supporting DESC, mean_abs_error_ppm, structure) AS place FROM ({_MANIFEST}) QUALIFY place <= 25"))
def flat_pool_manifest(spark, d):
    """The best 25 of each group's pool from one flat tolerance, without adducts or policy."""
    from ..operators.scoring import top_k

    groups, asked, hits = b.shared_hits(spark, d)
    best = top_k(rounded(manifest(hits, asked)), "grp", 25, [F.desc("n_supporting"), F.col("mean_abs_error_ppm"), F.col("structure")])
    return pools.for_all(best.withColumn("place", F.col("rank").cast("long")).drop("rank"), groups)


@query(sql("pool", "SELECT mode, count(*) AS n_groups, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM (SELECT grp, mode, count(*) AS n FROM pool GROUP BY 1, 2) GROUP BY 1"))
def pool_profile(spark, d):
    groups, asked, hits = b.shared_hits(spark, d)
    sizes = pools.select_pool(hits, asked).groupBy("grp", "mode").agg(F.count("*").alias("size"))
    out = profiling.distribution(pools.for_all(sizes, groups), "size", ["mode"], {"p50": 0.5, "p90": 0.9})
    return rounded(out.withColumnRenamed("n", "n_groups"))


@query(sql("hits", "SELECT grp, n_base, n_combined, n_combined - n_base AS n_added, round(n_combined / nullif(n_base, 0), 6) AS growth FROM (SELECT grp, count(DISTINCT structure) AS n_combined, count(DISTINCT CASE WHEN structure % 3 <> 0 THEN structure END) AS n_base FROM hits GROUP BY 1)"))
def pool_growth(spark, d):
    groups, _, hits = b.shared_hits(spark, d)
    return pools.for_all(rounded(catalog.growth(hits.where("structure % 3 <> 0"), hits, "grp", "structure")), groups)


@query(sql("hits", "SELECT h.spectrum_id, h.structure, h.smiles, round(h.exact_mass, 6) AS candidate_mass, round(h.mass, 6) AS neutral_mass, round((h.mass - h.exact_mass) / h.exact_mass * 1e6, 6) AS error_ppm, 'F' || h.structure % 3 AS candidate_formula, CASE WHEN h.spectrum_id % 5 <> 0 THEN h.structure % 3 = h.spectrum_id % 3 END AS formula_match, (h.spectrum_id % 4 = 0 OR abs((h.mass - h.exact_mass) / h.exact_mass * 1e6) <= 100) AS mass_ok, h.spectrum_id % 4 <> 0 AS trusted, (h.spectrum_id % 4 = 0 OR abs((h.mass - h.exact_mass) / h.exact_mass * 1e6) <= 100) AND (h.spectrum_id % 5 = 0 OR h.structure % 3 = h.spectrum_id % 3) AS accepted FROM hits h"))
def candidate_constraints(spark, d):
    """Every hit against mass and formula: an untrusted adduct passes the mass test, an unknown formula its own."""
    rows = b.class_hits(spark, d, shown=("structure", "smiles"))
    own = F.concat(F.lit("F"), (F.col("structure") % 3).cast("string"))
    known = F.when(F.col("spectrum_id") % 5 != 0, F.concat(F.lit("F"), (F.col("spectrum_id") % 3).cast("string")))
    x = chem.candidate_verdict(F.col("mass"), F.col("exact_mass"), own, known, F.col("spectrum_id") % 4 != 0, 100.0)
    fields = ["candidate_formula", "formula_match", "mass_ok", "trusted", "accepted"]
    same = {"candidate_mass": F.round("exact_mass", 6), "neutral_mass": F.round("mass", 6), "error_ppm": F.round(chem.error_ppm(F.col("mass"), F.col("exact_mass")), 6)}  # of a class, rounded once
    hits = mass_classes.pairs(rows.withColumns(same), "mass", "exact_mass", *same).withColumn("v", x)
    return hits.select("spectrum_id", "structure", "smiles", *same, *[f"v.{c}" for c in fields])


def chemistry_filter(spark, d, hard: bool):
    """Ranked candidates within 30 ppm; with ``hard`` a query may end empty, else it falls back to all of its own."""
    rows = b.class_hits(spark, d)
    lists = mass_classes.nearest_lists(rows.where(F.abs("error_ppm") <= 30) if hard else rows, ["mass"], lambda m: F.struct(F.abs("error_ppm").alias("size"), m["structure"].alias("structure")))
    best = F.col("best") if hard else F.when(F.col("best")[0]["size"] <= 30, F.filter("best", lambda e: e["size"] <= 30)).otherwise(F.col("best"))
    return mass_classes.ranked_pairs(lists.withColumn("best", F.transform(best, lambda e: F.struct(e["structure"].alias("structure")))), "rank")


@query(sql("hits", "SELECT spectrum_id, structure, row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(error_ppm), structure) AS rank FROM hits WHERE abs(error_ppm) <= 30"))
def chemistry_filter_hard(spark, d):
    return chemistry_filter(spark, d, True)


@query(sql("hits", "SELECT spectrum_id, structure, row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(error_ppm), structure) AS rank FROM (SELECT *, bool_or(abs(error_ppm) <= 30) OVER (PARTITION BY spectrum_id) AS any_pass FROM hits) WHERE abs(error_ppm) <= 30 OR NOT any_pass"))
def chemistry_filter_soft(spark, d):
    return chemistry_filter(spark, d, False)


@query(sql("hits", "SELECT grp, structure FROM (SELECT grp, structure, bool_or(abs(error_ppm) <= 30 AND (NOT any_hard OR hard)) AS passes FROM (SELECT *, spectrum_id % 4 <> 0 AS hard, bool_or(spectrum_id % 4 <> 0) OVER (PARTITION BY grp) AS any_hard FROM hits) GROUP BY 1, 2) WHERE passes"))
def multi_observation_filter(spark, d):
    """Hard observations, where a group has any, put the soft ones aside; one matching observation lets a candidate pass."""
    from pyspark.sql import Window

    groups, _, hits = b.shared_hits(spark, d, hard=F.col("spectrum_id") % 4 != 0)
    rows = hits.withColumn("any_hard", F.max("hard").over(Window.partitionBy("grp")))
    passed = rows.groupBy("grp", "structure").agg(F.max((F.abs("error_ppm") <= 30) & (~F.col("any_hard") | F.col("hard"))).alias("passes")).where("passes")
    return pools.for_all(passed.select("grp", "structure"), groups)


@query("SELECT i.p_partkey, f.formula, round(f.mass, 6) AS mass, f.n_c FROM part i JOIN (VALUES (0, 'C6H12O6', 6 * 12e0 + 12 * 1.00782503223e0 + 6 * 15.99491461957e0, 6), (1, 'C10H12ClNO', 10 * 12e0 + 12 * 1.00782503223e0 + 34.968852682e0 + 14.00307400443e0 + 15.99491461957e0, 10), (2, 'C8H10N4O2-', 8 * 12e0 + 10 * 1.00782503223e0 + 4 * 14.00307400443e0 + 2 * 15.99491461957e0, 8), (3, 'CH3CH2OH+2', 2 * 12e0 + 6 * 1.00782503223e0 + 15.99491461957e0, 2)) f(k, formula, mass, n_c) ON i.p_partkey % 4 = f.k")
def formula_masses(spark, d):
    names = F.array(*[F.lit(x) for x in ("C6H12O6", "C10H12ClNO", "C8H10N4O2-", "CH3CH2OH+2")])
    x = b.table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("formula"))
    return rounded(x.select("p_partkey", "formula", chem.formula_mass(F.col("formula")).alias("mass"), chem.parse_formula(F.col("formula"))["C"].alias("n_c")))


_FORMULAS = ("C6H12O6", "C10H12ClNO", "not a formula", "C8H10N4O2", "C6H12X6")
_FORMULA_SQL = "SELECT p_partkey, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 6 * 12e0 + 12 * 1.00782503223e0 + 6 * 15.99491461957e0 WHEN 1 THEN 10 * 12e0 + 12 * 1.00782503223e0 + 34.968852682e0 + 14.00307400443e0 + 15.99491461957e0 WHEN 3 THEN 8 * 12e0 + 10 * 1.00782503223e0 + 4 * 14.00307400443e0 + 2 * 15.99491461957e0 END AS mass FROM part"


@query(f"SELECT count(*) AS n, count_if(k = 2)::BIGINT AS n_unparsable, count_if(k = 4)::BIGINT AS n_unknown_element, count_if(ppm IS NOT NULL)::BIGINT AS n_compared, count_if(abs(ppm) <= 5)::BIGINT AS n_within_5, count_if(abs(ppm) > 5)::BIGINT AS n_beyond_5, round(max(abs(ppm)), 6) AS worst_ppm FROM (SELECT *, (stored - mass) / mass * 1e6 AS ppm FROM (SELECT *, mass * (1 + (p_partkey % 13 - 6) * 1e-6) AS stored FROM ({_FORMULA_SQL})))")
def formula_consistency(spark, d):
    """Stored masses against the masses of their parsed formulas."""
    names = F.array(*[F.lit(x) for x in _FORMULAS])
    rows = b.table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("formula"))
    rows = rows.withColumn("mass", chem.formula_mass(F.col("formula")))
    stored = F.col("mass") * (F.lit(1) + (F.col("p_partkey") % 13 - 6) * F.lit(1e-6))
    return rounded(catalog.formula_consistency(rows.withColumn("stored", stored), "formula", "stored"))


@query(sql("variants", "SELECT structure, smiles, variant_count FROM (SELECT v.structure, v.smiles, count(*) OVER (PARTITION BY v.structure) AS variant_count, row_number() OVER (PARTITION BY v.structure ORDER BY v.exact_mass, v.smiles) AS n FROM variants v) WHERE n = 1"))
def mass_index_self_check(spark, d):
    """Each structure's lightest variant finds its own structure with no error."""
    from ..operators.splits import first_of

    v = b.variants(spark, d)
    lightest = first_of(v, ["structure"], [F.col("exact_mass"), F.col("smiles")]).select(F.col("structure").alias("spectrum_id"), F.col("exact_mass").alias("mass"))
    own = range_join.mass_hits(lightest, v, 10.0).where("structure = spectrum_id and error_ppm = 0")
    return own.select("structure", "smiles", "variant_count")


@query(sql("variants", "SELECT count(*) AS n_structures, count(*) AS n_found, 100e0 AS percent FROM (SELECT DISTINCT structure FROM variants WHERE exact_mass > 0)"))
def mass_index_build(spark, d):
    """The stored mass index, and how many structures all of whose variants find their own structure in it."""
    return mass_index.self_check(spark, mass_index.build_mass_index(b.variants(spark, d)))


@query(sql("hits", "SELECT spectrum_id, structure, round(error_ppm, 6) AS error_ppm, variant_count, row_number() OVER (PARTITION BY spectrum_id ORDER BY abs(error_ppm), structure) AS place FROM hits QUALIFY place <= 10"))
def mass_index_search(spark, d):
    """The ten nearest structures of each spectrum, from the stored index: made for 10 ppm, asked for a wider window."""
    index = mass_index.build_mass_index(b.variants(spark, d))
    spectra = b.spectra(spark, d)
    stored = mass_index.stored_rows(spark, index, range_join.windows(spectra.select("mass").distinct(), b.PPM, "mass", index.step))
    hits = mass_classes.class_hits(mass_classes.owners(spectra, ["mass"]), mass_classes.members(stored), b.PPM)
    near = mass_classes.nearest_lists(hits, ["mass"], lambda m: F.struct(F.abs("error_ppm").alias("size"), m["structure"].alias("structure"), F.round("error_ppm", 6).alias("error_ppm"), F.col("variant_count")), 10)
    return mass_classes.ranked_pairs(near, "place").select("spectrum_id", "structure", "error_ppm", "variant_count", "place")


@query("SELECT o_orderkey, round(keyed, 9) AS fraction, CASE WHEN keyed < 0.1 THEN 'validation' ELSE 'train' END AS split, substr(o_orderpriority, 1, 3) AS block, o_orderkey || '|' || o_orderpriority AS query_id FROM (SELECT *, ('0x' || substr(sha256('split-v1|' || o_orderkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616e0 AS keyed FROM orders)")
def hashed_keys(spark, d):
    key = F.col("o_orderkey").cast("string")
    return b.table(spark, d, "orders").select("o_orderkey", F.round(keys.stable_fraction(key), 9).alias("fraction"), keys.assign_split(key).alias("split"), keys.first_block(F.col("o_orderpriority"), 3).alias("block"), keys.query_id(key, F.col("o_orderpriority")).alias("query_id"))
