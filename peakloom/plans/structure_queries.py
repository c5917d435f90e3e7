"""Queries over structures given as SMILES texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import smiles
from . import bindings as b
from .bindings import query, rounded

# a carbon chain as long as a part's size says, ending in a phenyl, an acid, an ammonium, three halogens, a morpholine or an open ring
_ENDS = ["c1ccccc1", "(=O)O", "[N+](C)(C)C", "(Cl)(Br)F", "N1CCOCC1", "1"]
_TEXTS = "SELECT p_partkey AS id, p_size % 12 + 1 AS n, p_partkey % 6 AS kind, p_partkey % 13 = 0 AS blank FROM part"
_COUNTS = f"""SELECT *, NOT blank AND kind < 5 AS good, n + CASE kind WHEN 0 THEN 6 WHEN 2 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS c,
    2 * n + CASE kind WHEN 0 THEN 6 WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN -1 ELSE 9 END AS h FROM ({_TEXTS})"""
_REST = "CASE kind WHEN 0 THEN '' WHEN 1 THEN 'O2' WHEN 2 THEN 'N+' WHEN 3 THEN 'BrClF' ELSE 'NO' END"
_REST_MASS = "CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 * 15.99491461957e0 WHEN 2 THEN 14.00307400443e0 WHEN 3 THEN 78.9183376e0 + 34.968852682e0 + 18.99840316273e0 ELSE 14.00307400443e0 + 15.99491461957e0 END"


def _structures(spark: SparkSession, d: str) -> DataFrame:
    """(id, smiles) of every part; every thirteenth has none."""
    k = F.col("p_partkey")
    end = F.get(F.array(*map(F.lit, _ENDS)), (k % 6).cast("int"))
    chain = F.repeat(F.lit("C"), (F.col("p_size") % 12 + 1).cast("int"))
    return b.table(spark, d, "part").select(k.alias("id"), F.when(k % 13 != 0, F.concat(chain, end)).alias("smiles"))


@query(f"""SELECT id, CASE WHEN blank THEN 'empty' WHEN good THEN 'read' ELSE 'malformed' END AS fate,
    CASE WHEN good THEN 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || 'H' || CASE WHEN h > 1 THEN h::VARCHAR ELSE '' END || {_REST} END AS formula,
    CASE WHEN good THEN CASE WHEN kind = 2 THEN 1 ELSE 0 END END AS charge, CASE WHEN good THEN round(c * 12e0 + h * 1.00782503223e0 + {_REST_MASS}, 6) END AS exact_mass FROM ({_COUNTS})""")
def smiles_formulas(spark, d):
    """Formula, charge and mass of structures known by their SMILES alone."""
    rows = smiles.with_smiles(_structures(spark, d))
    return rounded(rows.select("id", F.col("smiles_fate").alias("fate"), F.col("smiles_formula").alias("formula"), F.col("smiles_charge").alias("charge"), F.col("smiles_mass").alias("exact_mass")))


@query(f"""SELECT kind, count_if(good AND ((kind = 1 AND n = 2) OR (kind = 0 AND n = 4))) AS n_matching, count_if(good)::BIGINT AS n_read, count(*) AS n
    FROM ({_COUNTS}) GROUP BY kind""")
def formula_matches(spark, d):
    """How many structures of each kind have one of two expected formulas, exactly."""
    expected = F.when(F.col("kind") == 0, "C10H14").otherwise("C2H4O2")
    rows = _structures(spark, d).withColumn("kind", F.col("id") % 6).withColumn("graph", smiles.smiles_graph(F.col("smiles")))
    matching = rows.select("kind", smiles.formula_matches(expected, F.col("graph")).alias("same"), F.col("graph.fate").alias("fate"))
    return matching.groupBy("kind").agg(F.count_if("same").alias("n_matching"), F.count_if(F.col("fate") == "read").alias("n_read"), F.count("*").alias("n"))


@query("")
def structure_fingerprints(spark, d):
    """Circular fingerprints of 2,048 bits and radius 2, packed as the places of their set bits; null where a text isn't read."""
    rows = _structures(spark, d)
    # equal texts are read once; a fixed number of tasks, as texts are short and the work on one is long
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = rows.select(F.col("smiles").alias("text")).distinct().repartition(tasks, "text").withColumn("graph", smiles.smiles_graph(F.col("text")))
    made = texts.select("text", F.col("graph.fate").alias("fate"), smiles.active_bits(F.col("graph")).alias("bits"))
    shown = made.select("text", "fate", F.when(F.col("bits").isNotNull(), F.size("bits")).alias("active_bits"), F.array_join("bits", " ").alias("bits"))
    return rows.join(shown, rows.smiles.eqNullSafe(shown.text)).select("id", "fate", "active_bits", "bits")
