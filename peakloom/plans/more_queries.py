"""Further queries: mass lookups, compound keys, error by adduct, the reranker's rows, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chem, keys
from ..operators import cells, pools, scoring
from ..operators.profiling import weighted_mean
from . import bindings as b
from .bindings import query, rounded, sql
from .ranking_queries import _FEATURES, BY, _features


@query(sql("variants", "SELECT structure, string_agg(DISTINCT m, ';' ORDER BY m) AS masses, count(DISTINCT m) AS n FROM (SELECT structure, lpad(round(exact_mass * 1000)::BIGINT::VARCHAR, 9, '0') AS m FROM variants WHERE exact_mass > 0) GROUP BY 1"))
def exact_mass_lookup(spark, d):
    """Sorted distinct positive masses of each structure, in thousandths."""
    m = F.lpad(F.round(F.col("exact_mass") * 1000).cast("long").cast("string"), 9, "0")
    out = b.variants(spark, d).where("exact_mass > 0").groupBy("structure").agg(F.array_sort(F.collect_set(m)).alias("m"))
    return out.select("structure", F.array_join("m", ";").alias("masses"), F.size("m").cast("long").alias("n"))


@query(sql("ions hits", "SELECT adduct, count(*) AS n, round(median(abs(error_ppm)), 6) AS median, round(quantile_cont(abs(error_ppm), 0.9), 6) AS p90, round(quantile_cont(abs(error_ppm), 0.99), 6) AS p99, round(avg((abs(error_ppm) <= 20)::INT), 6) AS within_20, round(avg((abs(error_ppm) <= 50)::INT), 6) AS within_50 FROM hits JOIN ions USING (spectrum_id) WHERE supported GROUP BY 1"))
def error_by_adduct(spark, d):
    strata = b.ions(spark, d).where("supported").groupBy("mass", "adduct").agg(F.count("*").alias("weight"))
    rows = b.weighted_hits(spark, d, strata).withColumn("size", F.abs("error_ppm"))
    shares = [weighted_mean((F.col("size") <= t).cast("double"), "weight").alias(f"within_{t}") for t in (20, 50)]
    return rounded(cells.aggregated(rows, ["adduct"], [F.sum("weight").alias("n"), *shares], "size", {"median": 0.5, "p90": 0.9, "p99": 0.99}, "weight"))


@query(sql("ions", "SELECT adduct, count(*) AS n, round(median((mz * abs(charge) - mass_shift) / multimer - mass), 6) AS median_da, round(median(abs(((mz * abs(charge) - mass_shift) / multimer - mass) / mass * 1e6)), 6) AS median_abs_ppm FROM ions WHERE supported GROUP BY 1"))
def adduct_mass_validation(spark, d):
    x = b.ions(spark, d).where("supported").withColumn("neutral", chem.neutral_mass(F.col("mz"), F.col("charge"), F.col("multimer"), F.col("mass_shift")))
    x = x.withColumn("da", chem.error_da(F.col("neutral"), F.col("mass"))).withColumn("ppm", F.abs(chem.error_ppm(F.col("neutral"), F.col("mass"))))
    out = cells.aggregated(x, ["adduct"], [F.count("*").alias("n")], "da", {"median_da": 0.5})
    return rounded(out.join(cells.quantiles(x, "ppm", {"median_abs_ppm": 0.5}, ["adduct"]), "adduct"))


_FOUR = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"SELECT {_FOUR}, n_all, n_returned FROM (SELECT {_FOUR}, count(*) AS n_all FROM lineitem GROUP BY ALL) JOIN (SELECT {_FOUR}, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) USING ({_FOUR})")
def compound_key_join(spark, d):
    """Two tables that are unique in a key of four columns, joined on it."""
    rows, on = b.table(spark, d, "lineitem"), _FOUR.split(", ")
    every = rows.groupBy(*on).agg(F.count("*").alias("n_all"))
    return pools.one_to_one(every, rows.where("l_returnflag = 'R'").groupBy(*on).agg(F.count("*").alias("n_returned")), on)


@query("SELECT o_orderkey, o_custkey, count(*) OVER w AS group_size, round(sum(o_totalprice) OVER w, 3) AS group_total, round(o_totalprice / max(o_totalprice) OVER w, 6) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def group_transforms(spark, d):
    """Values of the group beside each of its rows."""
    w = Window.partitionBy("o_custkey")
    rows = b.table(spark, d, "orders")
    return rows.select("o_orderkey", "o_custkey", F.count("*").over(w).alias("group_size"), F.round(F.sum("o_totalprice").over(w), 3).alias("group_total"), F.round(F.col("o_totalprice") / F.max("o_totalprice").over(w), 6).alias("share"))


@query(sql("scored", f"WITH f AS ({_FEATURES}), t AS (SELECT grp, min(structure) FILTER (structure % 5 = grp % 5) AS truth FROM f GROUP BY 1) SELECT 'm' || f.grp || '|lib' AS query_id, 'm' || f.grp AS molecule, f.structure AS candidate_id, (f.structure = t.truth)::INT AS target, {', '.join(f'round(f.{c}, 5) AS {c}' for c in scoring.MODEL_FEATURES)} FROM f JOIN t USING (grp) WHERE t.truth IS NOT NULL").replace(") WITH f AS", "), f AS"))
def reranker_dataset(spark, d):
    """Features with one positive a query; a query whose true structure isn't in its pool has no rows."""
    rows = rounded(_features(spark, d), 5)
    truth = rows.groupBy("grp").agg(F.min(F.when(F.col("structure") % 5 == F.col("grp") % 5, F.col("structure"))).alias("truth")).where("truth is not null")
    name = F.concat(F.lit("m"), F.col("grp").cast("string"))
    full = rows.join(truth, "grp").withColumn("query_id", keys.query_id(name, F.lit("lib")))
    return full.select("query_id", keys.molecule_of(F.col("query_id")).alias("molecule"), F.col("structure").alias("candidate_id"), (F.col("structure") == F.col("truth")).cast("int").alias("target"), *scoring.MODEL_FEATURES)


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(nullif(trim(source), ''), 'unknown') AS source FROM documents LEFT JOIN labels USING (doc_id)")
def null_defaults(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", "source").join(b.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("source"))


@query("SELECT '{\"n_rows\":' || count(*) || ',\"n_keys\":' || count(DISTINCT o_custkey) || '}' AS summary FROM orders")
def json_summary(spark, d):
    one = b.table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"))
    return one.select(F.to_json(F.struct("n_rows", "n_keys")).alias("summary"))


@query(sql("spectra", "SELECT n_spectra, count(*) AS n_groups FROM (SELECT grp, count(DISTINCT spectrum_id) AS n_spectra FROM spectra GROUP BY 1) GROUP BY 1"))
def spectra_per_group(spark, d):
    return b.spectra(spark, d).groupBy("grp").agg(F.count_distinct("spectrum_id").alias("n_spectra")).groupBy("n_spectra").agg(F.count("*").alias("n_groups"))


@query(sql("scored", "SELECT grp, structure, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, n FROM (SELECT p.grp, p.structure, avg(s.score) AS mean_score, max(s.score) AS max_score, count(*) AS n FROM (SELECT DISTINCT grp, structure FROM scored WHERE structure % 4 = 1) p JOIN scored s USING (grp, structure) GROUP BY 1, 2)"))
def unmasked_scores(spark, d):
    """Evaluation's way: every spectrum of the group counts for every candidate of the pool, supporting or not."""
    rows = b.scored(spark, d)
    pool = rows.where("structure % 4 = 1").select(*BY).distinct()
    return rounded(rows.join(pool, BY).groupBy(*BY).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n")))
