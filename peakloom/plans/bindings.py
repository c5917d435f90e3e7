"""Views over the star-schema tables that stand in for spectra, peaks, candidates and scores, in DataFrames and SQL.

Each view has its SQL under the same name, so that a query's SQL starts from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chem import ADDUCTS

PPM = 150.0
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

VIEWS = {
    "peaks": "SELECT l_orderkey AS spectrum_id, l_extendedprice / 100 AS mz, l_quantity / 50 AS intensity FROM lineitem",
    "coarse": "SELECT l_orderkey AS spectrum_id, floor(l_extendedprice / 100) AS mz, l_quantity / 50 AS intensity FROM lineitem",
    "variants": "SELECT p_partkey // 2 AS structure, p_retailprice AS exact_mass, p_name AS smiles, p_brand AS formula FROM part",
    "spectra": "SELECT event_id AS spectrum_id, event_id // 3 AS grp, 900e0 + ((event_id // 3) % 1000) / 10e0 + (event_id % 3) * 6e-2 + CASE WHEN event_id % 7 = 0 THEN 1e0 ELSE 0e0 END AS mass, event_type AS instrument, user_id % 5 AS lib FROM events",
    "adducts": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}, {m}, {s!r}::DOUBLE, {str(t).lower()})" for n, c, m, s, t in ADDUCTS) + ") AS a(adduct, charge, multimer, mass_shift, trusted)",
    "named": "SELECT *, CASE spectrum_id % 13 " + " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(ADDUCTS)) + " ELSE '[M+X]+' END AS adduct FROM spectra",
    "ions": "SELECT s.*, a.charge, a.multimer, a.mass_shift, a.adduct IS NOT NULL AS supported, coalesce(a.trusted, false) AS trusted, (a.multimer * s.mass + a.mass_shift) / abs(a.charge) AS mz FROM named s LEFT JOIN adducts a USING (adduct)",
    "counted": "SELECT structure, count(*) AS variant_count FROM variants GROUP BY structure",
    "all_hits": f"SELECT s.spectrum_id, s.grp, s.mass, v.structure, v.exact_mass, v.smiles, c.variant_count, v.exact_mass - s.mass AS error_da, (v.exact_mass - s.mass) / s.mass * 1e6 AS error_ppm FROM spectra s JOIN variants v ON v.exact_mass BETWEEN s.mass - s.mass * {PPM}e0 * 1e-6 AND s.mass + s.mass * {PPM}e0 * 1e-6 JOIN counted c ON c.structure = v.structure",
    "hits": "SELECT * FROM all_hits QUALIFY row_number() OVER (PARTITION BY spectrum_id, structure ORDER BY abs(error_ppm), exact_mass, smiles) = 1",
    "support": "SELECT h.grp, h.structure, count(DISTINCT h.spectrum_id) AS n_supporting, any_value(z.n) AS n_spectra FROM hits h JOIN (SELECT grp, count(DISTINCT spectrum_id) AS n FROM spectra GROUP BY grp) z USING (grp) GROUP BY h.grp, h.structure",
    "pool": "SELECT *, CASE WHEN full_any THEN 'intersection' ELSE 'union_fallback' END AS mode FROM (SELECT *, bool_or(n_supporting = n_spectra) OVER (PARTITION BY grp) AS full_any FROM support) WHERE n_supporting = n_spectra OR NOT full_any",
    "scored": "SELECT a.label AS grp, a.vec_id AS spectrum_id, b.vec_id AS structure, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1",
    "bins": "SELECT spectrum_id, floor(mz / 1e-1)::BIGINT AS bin, sum(intensity) AS v FROM peaks WHERE intensity > 0 AND mz >= 0 AND mz < 1000 GROUP BY 1, 2",
    "normed": "SELECT spectrum_id, bin, v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)) AS v FROM bins",
    "best_ranked": "SELECT grp AS query_id, structure AS candidate_id, score, (structure % 5 = 0)::INT AS target, row_number() OVER (PARTITION BY grp, spectrum_id ORDER BY score DESC, structure) AS rank, spectrum_id FROM scored",
    "ranks": "SELECT spectrum_id AS query_id, min(CASE WHEN candidate_id % 7 = spectrum_id % 7 AND spectrum_id % 10 <> 0 THEN rank END) AS rank FROM best_ranked GROUP BY spectrum_id",
    "keyed": "SELECT c_custkey::VARCHAR AS structure, c_nationkey, c_mktsegment, c_acctbal FROM customer",
    "rows": "SELECT o_orderkey AS row_index, o_custkey AS structure, o_orderpriority, o_totalprice, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_test_like FROM orders",
    "unknown": "SELECT event_id AS spectrum_id, event_id // 3 AS grp, (900e0 + ((event_id // 3) % 1000) / 10e0 + CASE WHEN event_id % 7 = 0 THEN 1e-1 ELSE 0e0 END) * (1e0 + ((event_id * 7) % 11 - 5) * 43e-1 * 1e-6) AS mass, CASE WHEN event_type = 'click' THEN 'timsTOF' ELSE 'QTOF' END AS instrument, CASE user_id % 5 WHEN 0 THEN 'pluskal_ms2' WHEN 1 THEN 'gnps' WHEN 2 THEN 'riken' WHEN 3 THEN 'elsewhere' ELSE 'msdial' END AS source, CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(ADDUCTS)) + " ELSE '[M+X]+' END AS adduct FROM events",
    "measured": "SELECT *, (mz * abs(charge) - mass_shift) / multimer AS neutral, supported AND trusted AS inferred, supported AND trusted AND (instrument = 'timsTOF' OR source IN ('pluskal_ms2', 'spectraverse', 'msdial')) AS learned FROM (SELECT u.*, a.charge, a.multimer, a.mass_shift, a.adduct IS NOT NULL AS supported, coalesce(a.trusted, false) AS trusted, (a.multimer * u.mass + a.mass_shift) / abs(a.charge) AS mz FROM unknown u LEFT JOIN adducts a USING (adduct))",
    "in_window": "SELECT m.spectrum_id, m.grp, m.source, m.instrument, m.inferred, m.learned, CASE WHEN m.instrument = 'timsTOF' THEN 10e0 ELSE 20e0 END AS ppm, v.structure, v.exact_mass, v.smiles, v.formula, (v.exact_mass - m.neutral) / m.neutral * 1e6 AS error_ppm FROM measured m JOIN variants v ON v.exact_mass BETWEEN m.neutral - m.neutral * 20e0 * 1e-6 AND m.neutral + m.neutral * 20e0 * 1e-6",
    "generated": "SELECT * FROM in_window WHERE inferred AND abs(error_ppm) <= ppm QUALIFY row_number() OVER (PARTITION BY spectrum_id, structure ORDER BY abs(error_ppm), exact_mass, smiles) = 1",
    "learnable": "SELECT * FROM in_window WHERE learned AND abs(error_ppm) <= 10 QUALIFY row_number() OVER (PARTITION BY spectrum_id, structure ORDER BY abs(error_ppm), exact_mass, smiles) = 1",
    "filtered_support": "SELECT g.grp, g.structure, arg_min(g.smiles, g.spectrum_id) AS smiles, arg_min(g.formula, g.spectrum_id) AS formula, any_value(f.n) AS num_filtered_spectra, any_value(z.n) AS num_spectra, count(*) AS num_supporting_spectra, avg(g.error_ppm) AS mean_mass_error_ppm, avg(abs(g.error_ppm)) AS mean_abs_mass_error_ppm FROM generated g JOIN (SELECT grp, count(DISTINCT spectrum_id) AS n FROM generated GROUP BY 1) f USING (grp) JOIN (SELECT grp, count(*) AS n FROM unknown GROUP BY 1) z USING (grp) GROUP BY 1, 2",
    "manifest": "SELECT * EXCLUDE (any_full), CASE WHEN any_full THEN 'intersection' ELSE 'union_fallback' END AS candidate_mode FROM (SELECT *, bool_or(num_supporting_spectra = num_filtered_spectra) OVER (PARTITION BY grp) AS any_full FROM filtered_support) WHERE num_supporting_spectra = num_filtered_spectra OR NOT any_full",
    "vecs": "SELECT vec_id, embedding, count_if(vec_id % 2 = 0) OVER () AS n_even, count_if(vec_id % 2 = 1) OVER () AS n_odd FROM embeddings",
    "supported_scores": "SELECT m.grp, m.structure, g.spectrum_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM manifest m JOIN generated g USING (grp, structure) JOIN vecs a ON a.vec_id = 2 * (g.spectrum_id % a.n_even) JOIN vecs b ON b.vec_id = 2 * (m.structure % b.n_odd) + 1",
    "truths": "SELECT DISTINCT event_id // 3 AS grp, ((event_id // 3) % 1000) // 2 + 500 * ((event_id // 3) % 2) AS truth FROM events",
    "source_a": "SELECT * FROM variants WHERE structure % 3 <> 0",
    "source_b": "SELECT * FROM variants WHERE structure % 3 <> 1",
}
NEEDS = {"named": ["spectra"], "ions": ["adducts", "named"], "counted": ["variants"], "all_hits": ["spectra", "counted"], "hits": ["all_hits"], "support": ["hits"], "pool": ["support"], "bins": ["peaks"], "normed": ["bins"], "best_ranked": ["scored"], "ranks": ["best_ranked"], "measured": ["adducts", "unknown"], "in_window": ["measured", "variants"], "generated": ["in_window"], "learnable": ["in_window"], "filtered_support": ["generated"], "manifest": ["filtered_support"], "supported_scores": ["manifest", "vecs"], "source_a": ["variants"], "source_b": ["variants"]}


def sql(names: str, body: str) -> str:
    """``body`` after the WITH clauses of the views in ``names`` and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " if order else "") + body


def query(text: str) -> Callable:
    """Register a function under its name, with the SQL that gives its rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTERED[f.__name__] = (f, text)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out by its key first, as the joins after it multiply its rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def peaks(spark: SparkSession, d: str, coarse: bool = False) -> DataFrame:
    mz = F.col("l_extendedprice") / 100
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spectrum_id"), (F.floor(mz).cast("double") if coarse else mz).alias("mz"), (F.col("l_quantity") / 50).alias("intensity"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.expr("p_partkey div 2").alias("structure"), F.col("p_retailprice").alias("exact_mass"), F.col("p_name").alias("smiles"), F.col("p_brand").alias("formula"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    mass = F.expr("900D + ((event_id div 3) % 1000) / 10D + (event_id % 3) * 6e-2D + CASE WHEN event_id % 7 = 0 THEN 1D ELSE 0D END")
    return spread(table(spark, d, "events").select(F.col("event_id").alias("spectrum_id"), F.expr("event_id div 3").alias("grp"), mass.alias("mass"), F.col("event_type").alias("instrument"), (F.col("user_id") % 5).alias("lib")), "spectrum_id")


def ions(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.chem import precursor_mz, with_adducts

    names = F.array(*[F.lit(a[0]) for a in ADDUCTS], F.lit("[M+X]+"))
    named = spectra(spark, d).withColumn("adduct", F.get(names, (F.col("spectrum_id") % 13).cast("int")))
    return with_adducts(named).withColumn("mz", precursor_mz(F.col("mass"), F.col("charge"), F.col("multimer"), F.col("mass_shift")))


def hits(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.range_join import mass_hits

    return mass_hits(spectra(spark, d), variants(spark, d), PPM)


def class_hits(spark: SparkSession, d: str, shown: tuple[str, ...] = ("structure",)) -> DataFrame:
    """``hits`` as ``mass_classes.class_hits``: spectra of one mass with classes of structures, whose members have ``shown``."""
    from ..operators import mass_classes
    from ..operators.range_join import with_neighbours

    asked = mass_classes.owners(spectra(spark, d), ["mass"])
    return mass_classes.class_hits(asked, mass_classes.members(with_neighbours(variants(spark, d)), shown), PPM)


def weighted_masses(rows: DataFrame, *by: str) -> DataFrame:
    """(mass, by..., weight): the number of different spectra of a mass."""
    return rows.select("spectrum_id", "mass", *by).distinct().groupBy("mass", *by).agg(F.count("*").alias("weight"))


def weighted_hits(spark: SparkSession, d: str, strata: DataFrame) -> DataFrame:
    """``strata`` (mass, weight, other columns) with error_ppm of each class of structures in the mass's window; weight: the hits of all its spectra."""
    from ..operators import mass_classes
    from ..operators.range_join import with_neighbours

    near = with_neighbours(variants(spark, d)).groupBy("exact_mass", "__lighter", "__heavier").agg(F.count("*").alias("n_members"))
    found = mass_classes.class_hits(strata.select("mass").distinct(), near, PPM).groupBy("mass", "error_ppm").agg(F.sum("n_members").alias("n_members"))
    return found.join(strata, "mass").withColumn("weight", F.col("weight") * F.col("n_members")).drop("n_members")


def shared_hits(spark: SparkSession, d: str, **shown: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, asked, hits): every group with the one that stands for it (equal masses, and equal ``shown``), the
    spectra of those, and their hits. What a query makes of the hits of a group, ``pools.for_all`` gives to all groups."""
    from ..operators import pools
    from ..operators.range_join import mass_hits
    from ..sources.files import materialized

    rows = spectra(spark, d).withColumns(shown) if shown else spectra(spark, d)
    groups = materialized(pools.stand_ins(rows, ["mass", *shown]), "groups")  # three steps read it
    asked = pools.asked(groups)
    return groups, asked, mass_hits(asked, variants(spark, d), PPM)


def unknown(spark: SparkSession, d: str) -> DataFrame:
    """Spectra of unknown molecules: groups of three, measured a few ppm off, every adduct and one that is not known."""
    from ..functions.chem import precursor_mz, with_adducts

    base = F.expr("900D + ((event_id div 3) % 1000) / 10D + CASE WHEN event_id % 7 = 0 THEN 1e-1D ELSE 0D END")
    mass = base * (F.lit(1.0) + ((F.col("event_id") * 7) % 11 - 5) * F.lit(4.3) * F.lit(1e-6))
    names, sources = F.array(*[F.lit(a[0]) for a in ADDUCTS], F.lit("[M+X]+")), F.array(*[F.lit(x) for x in ("pluskal_ms2", "gnps", "riken", "elsewhere", "msdial")])
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("spectrum_id"),
        F.expr("event_id div 3").alias("grp"),
        mass.alias("mass"),
        F.when(F.col("event_type") == "click", "timsTOF").otherwise("QTOF").alias("instrument"),
        F.get(sources, (F.col("user_id") % 5).cast("int")).alias("source"),
        F.get(names, (F.col("event_id") % 13).cast("int")).alias("adduct"),
    )
    return with_adducts(spread(rows, "spectrum_id")).withColumn("precursor_mz", precursor_mz(F.col("mass"), F.col("charge"), F.col("multimer"), F.col("mass_shift"))).drop("mass")


def truths(spark: SparkSession, d: str) -> DataFrame:
    """(grp, truth): each group's true structure, which its pool may lack."""
    grp = F.expr("event_id div 3")
    return table(spark, d, "events").select(grp.alias("grp")).distinct().withColumn("truth", F.expr("(grp % 1000) div 2 + 500 * (grp % 2)"))


def with_vectors(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows of (spectrum_id, structure) with the score of their vectors: spectra take the even ids in turn, structures the odd ones."""
    from ..functions.vectors import dot

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    counts = e.agg(F.count_if(F.col("vec_id") % 2 == 0).alias("__even"), F.count_if(F.col("vec_id") % 2 == 1).alias("__odd"))
    keyed = rows.crossJoin(F.broadcast(counts))  # one row
    keyed = keyed.withColumn("__a", F.col("spectrum_id") % F.col("__even") * 2).withColumn("__c", F.col("structure") % F.col("__odd") * 2 + 1)
    a, c = e.select(F.col("vec_id").alias("__a"), F.col("embedding").alias("__va")), e.select(F.col("vec_id").alias("__c"), F.col("embedding").alias("__vc"))
    both = keyed.join(a, "__a").join(c, "__c")
    return both.withColumn("score", dot(F.col("__va"), F.col("__vc"))).drop("__a", "__va", "__c", "__vc", "__even", "__odd")


def vector_ids(rows: DataFrame, spark: SparkSession, d: str, key: str) -> DataFrame:
    """``rows`` with vec, the id of the vector that ``with_vectors`` gives to a spectrum (``key`` spectrum_id) or a structure."""
    odd = key == "structure"
    count = table(spark, d, "embeddings").agg(F.count_if(F.col("vec_id") % 2 == int(odd)).alias("__n"))
    return rows.crossJoin(F.broadcast(count)).withColumn("vec", F.col(key) % F.col("__n") * 2 + int(odd)).drop("__n")  # one row


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spectrum vectors (even ids) and candidate vectors (odd ids) of one label."""
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.col("label").alias("grp"), F.col("vec_id").alias("spectrum_id"), "embedding")
    return a, e.where("vec_id % 2 = 1").select(F.col("label").alias("grp"), F.col("vec_id").alias("structure"), "embedding")


def scored(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import dense_scores

    return dense_scores(*vectors(spark, d))


def score_blocks(spark: SparkSession, d: str, wanted: str) -> DataFrame:
    """``group_blocks.statistics`` of all spectra of each candidate's label."""
    from ..operators import group_blocks

    a, c = vectors(spark, d)
    spectra = group_blocks.packed(a, "grp", "spectrum_id", "embedding", group_blocks.SPECTRA)
    candidates = group_blocks.packed(c, "grp", "structure", "embedding", group_blocks.CANDIDATES)
    return group_blocks.statistics(spectra, candidates, wanted).withColumn("grp", F.col("grp").cast(dict(a.dtypes)["grp"]))


def blocks_of_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame] | None:
    """``scored`` as packed (spectra, candidates); none where a vector has scores that blocks leave out."""
    from ..operators import group_blocks
    from ..sources.files import materialized

    if not group_blocks.sound(table(spark, d, "embeddings"), "label", "embedding"):
        return None
    a, c = vectors(spark, d)
    packed = group_blocks.packed(a, "grp", "spectrum_id", "embedding", group_blocks.SPECTRA // 4), group_blocks.packed(c, "grp", "structure", "embedding", group_blocks.SPECTRA // 4)
    return materialized(packed[0], "spectrum-blocks"), materialized(packed[1], "candidate-blocks")


def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import ranked

    rows = ranked(scored(spark, d), "spectrum_id", [F.desc("score"), F.col("structure")])
    return rows.withColumn("hit", (F.col("structure") % 7 == F.col("spectrum_id") % 7) & (F.col("spectrum_id") % 10 != 0))


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, rank): every tenth query has no true candidate."""
    from ..operators import group_blocks
    from ..sources.files import materialized

    a, c = vectors(spark, d)
    blocks = materialized(group_blocks.packed(c, "grp", "structure", "embedding", group_blocks.CANDIDATES), "candidate-blocks")  # both steps read it
    wanted = group_blocks.packed(a.where("spectrum_id % 10 <> 0"), "grp", "spectrum_id", "embedding", group_blocks.SPECTRA // 4)
    best = group_blocks.best_true(wanted, blocks, lambda q, r: r % 7 == q % 7)
    asked = a.join(best.withColumnRenamed("query", "spectrum_id"), "spectrum_id", "left")
    own = group_blocks.packed(asked, "grp", "spectrum_id", "embedding", group_blocks.SPECTRA // 4, ("best", "best_id"))
    return group_blocks.places(own, blocks).withColumnRenamed("query", "query_id")


def bins(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.peaks import sparse_bins

    return sparse_bins(peaks(spark, d))


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_custkey").alias("structure"), "o_orderpriority", "o_totalprice", good.alias("is_test_like"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
