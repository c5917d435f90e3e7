"""Queries over sources, sinks, checks and diagnostics, on data that trips every counter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import peak_arrays, vectors
from ..operators import group_blocks, metrics, peaks, pools, profiling, ranker, scoring, splits, trees
from ..schemas import checked, looked_up, require, violations
from ..sources import arrays, files
from . import bindings as b
from .bindings import query, rounded, sql
from .inference_queries import ENSEMBLE, WEIGHTS, tree_sql
from .ranking_queries import _FEATURES, _features
from .spectrum_queries import PAIRS, drawn_scores


# sources and sinks
@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def csv_round_trip(spark, d):
    """A table written as CSV with a header and read again under a given schema."""
    path = files.scratch_path(spark, "csv")
    files.write_csv(b.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return rounded(files.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, label FROM embeddings")
def parquet_round_trip(spark, d):
    """Array columns written as zstd Parquet in parts by label and of bounded files, read again with the columns asked for."""
    path = files.scratch_path(spark, "arrays")
    files.write_parquet(b.table(spark, d, "embeddings"), path, ["label"], rows_per_file=40)
    rows = files.read_parquet(spark, path, ["vec_id", "embedding", "label"])
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"), F.col("label").cast("int").alias("label"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id >= (SELECT max(vec_id) FROM embeddings) // 2 UNION ALL SELECT -1, count(*), round(sum(embedding[1]::DOUBLE), 4) FROM embeddings")
def array_round_trip(spark, d):
    """Vectors written as NPY shards by range of id: the upper half, whose shards alone are read, and one row over all."""
    path = files.scratch_path(spark, "npy")
    e = b.table(spark, d, "embeddings")
    arrays.write_arrays(e, path, "vec_id", "embedding", shard_rows=200)
    back = arrays.read_arrays(spark, path)
    middle = e.agg(F.max("vec_id")).first()[0] // 2
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    upper = arrays.read_arrays(spark, path, middle).select(F.col("id").alias("vec_id"), F.size("vector").cast("long").alias("n"), F.round(total, 4).alias("total"))
    return upper.unionByName(back.agg(F.lit(-1).cast("long").alias("vec_id"), F.count("*").alias("n"), F.round(F.sum(F.get("vector", F.lit(0)).cast("double")), 4).alias("total")))


@query("SELECT count(*) AS n_rows, 7::BIGINT AS n_columns, true AS has_bytes, (SELECT count(*) FROM customer) AS n_written FROM lineitem")
def table_information(spark, d):
    """Rows, columns and file sizes from file metadata, and the rows of files that a bounded writer made."""
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    info = files.file_info(b.table(spark, d, "lineitem")).agg(F.sum("n_rows").alias("n_rows"), (F.min("bytes") > 0).alias("has_bytes"))
    path = files.scratch_path(spark, "bounded")
    files.write_parquet(b.table(spark, d, "customer"), path, rows_per_file=100)
    written = files.file_info(spark.read.parquet(path)).where("n_rows <= 100").agg(F.sum("n_rows").alias("n_written"))
    columns = files.column_info(rows).agg(F.count("*").alias("n_columns"))
    return info.crossJoin(columns).crossJoin(written).select("n_rows", "n_columns", "has_bytes", "n_written")


_SDF_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'empty' WHEN p_partkey % 7 = 0 THEN 'short key' WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 'bad mass' ELSE 'kept' END AS fate, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice WHEN p_partkey % 3 = 0 THEN 6 * 12e0 + 12 * 1.00782503223e0 + 6 * 15.99491461957e0 END AS mass FROM part"


def _molecules(spark, d):
    """The structure-data text of each part: some without a molecule block, with a short key, without a mass or a formula."""
    k = F.col("p_partkey")
    block = F.when(k % 11 == 0, "").otherwise("\n  x\n\n  0  0\nM  END")
    key = F.when(k % 7 == 0, "short").otherwise(F.concat(F.lit("K"), F.lpad(k.cast("string"), 13, "0"), F.lit("-REST")))
    item = lambda tag, value: F.concat(F.lit(f"> <{tag}>\n"), value, F.lit("\n\n"))
    mass = F.when(k % 5 != 0, item("MASS", F.col("p_retailprice").cast("string"))).otherwise("")
    formula = F.when(k % 3 == 0, item("FORMULA", F.lit("C6H12O6"))).otherwise("")
    title = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("part "), k.cast("string")))
    return b.table(spark, d, "part").select(F.concat(title, block, F.lit("\n"), item("ID", k.cast("string")), item("KEY", key), mass, formula, F.lit("$$$$")).alias("value"))


def sdf_rows(spark, d):
    path = files.scratch_path(spark, "sdf")
    _molecules(spark, d).write.text(path)
    return files.with_fate(files.read_sdf(spark, path, {"ID": "id", "KEY": "inchikey", "MASS": "exact_mass", "FORMULA": "formula"}), formula="formula")


@query(f"SELECT p_partkey AS id, 'K' || lpad(p_partkey::VARCHAR, 13, '0') AS structure, round(mass, 6) AS exact_mass FROM ({_SDF_SQL}) WHERE fate = 'kept'")
def sdf_structures(spark, d):
    """A structure-data file read by Spark: records with a molecule, a full key and a mass, given or from the formula."""
    return rounded(sdf_rows(spark, d).where("fate = 'kept'").select(F.col("id").cast("long").alias("id"), "structure", "exact_mass"))


@query(f"SELECT fate, count(*) AS n FROM ({_SDF_SQL}) GROUP BY 1")
def sdf_counts(spark, d):
    """What became of each record."""
    return sdf_rows(spark, d).groupBy("fate").agg(F.count("*").alias("n"))


_CHAIN = "SELECT p_partkey AS id, p_partkey % 12 + 1 AS n, p_partkey % 5 AS kind, p_partkey % 13 = 0 AS cut FROM part"
_CHAIN_ATOMS = "CASE kind WHEN 0 THEN 2 * n + 2 WHEN 1 THEN 2 * n + 2 WHEN 2 THEN 2 * n WHEN 3 THEN 2 * n + 4 ELSE 2 * n + 1 END"


def _chains(spark, d):
    """Connection tables of carbon chains as long as a part's number says, ending in nothing, -OH, =O, an ammonium or chlorine; some are cut."""
    k = F.col("p_partkey")
    n, kind = (k % 12 + 1).cast("int"), k % 5
    atom = lambda e: F.format_string("    0.0000    1.5000    0.0000 %-3s 0  0  0  0  0  0  0  0  0  0  0  0", e)
    bond = lambda i, order: F.format_string("%3d%3d%3d  0  0  0  0", i, i + 1, order)
    last = F.when(kind == 0, "").when(kind < 3, "O").when(kind == 3, "N").otherwise("Cl")
    more = F.when(kind == 0, 0).otherwise(1)
    atoms = F.concat(F.array_repeat(atom(F.lit("C")), n), F.when(kind == 0, F.array()).otherwise(F.array(atom(last))))
    bonds = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i < n + more), lambda i: bond(i, F.when((i == n) & (kind == 2), 2).otherwise(1)))
    charge = F.when(kind == 3, F.array(F.format_string("M  CHG  1 %3d   1", n + 1))).otherwise(F.array())
    table = F.concat(F.array(F.lit("chain"), F.lit("  x"), F.lit(""), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", n + more, n + more - 1)), F.when(k % 13 == 0, F.array()).otherwise(F.concat(atoms, bonds)), charge, F.array(F.lit("M  END")))
    return b.table(spark, d, "part").select(F.concat(F.array_join(table, "\n"), F.lit("\n> <ID>\n"), k.cast("string"), F.lit("\n\n> <KEY>\nK"), F.lpad(k.cast("string"), 13, "0"), F.lit("-REST\n\n$$$$")).alias("value"))


@query(f"SELECT id, CASE WHEN cut THEN 'bad mass' ELSE 'kept' END AS fate, CASE WHEN cut THEN 'malformed' ELSE 'read' END AS table_fate, CASE WHEN NOT cut THEN 'C' || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END || 'H' || ({_CHAIN_ATOMS})::VARCHAR || CASE kind WHEN 0 THEN '' WHEN 3 THEN 'N' WHEN 4 THEN 'Cl' ELSE 'O' END END AS formula, CASE WHEN NOT cut THEN CASE WHEN kind = 3 THEN 1 ELSE 0 END END AS charge, CASE WHEN NOT cut THEN round(n * 12e0 + ({_CHAIN_ATOMS}) * 1.00782503223e0 + CASE kind WHEN 0 THEN 0 WHEN 3 THEN 14.00307400443e0 WHEN 4 THEN 34.968852682e0 ELSE 15.99491461957e0 END, 6) END AS exact_mass FROM ({_CHAIN})")
def sdf_connection_tables(spark, d):
    """Formula, charge and mass of records that no item gives, from atoms, bonds, charges and the hydrogens that aren't drawn."""
    path = files.scratch_path(spark, "sdf-tables")
    _chains(spark, d).write.text(path)
    rows = files.with_fate(files.read_sdf(spark, path, {"ID": "id", "KEY": "inchikey"}).withColumn("exact_mass", F.lit(None).cast("string")), table=True)
    return rounded(rows.select(F.col("id").cast("long").alias("id"), "fate", "table_fate", F.col("table_formula").alias("formula"), F.col("table_charge").alias("charge"), "exact_mass"))


_MODEL_SCORE = " + ".join(f"{w!r}::DOUBLE * {c}" for c, w in zip(scoring.MODEL_FEATURES, WEIGHTS, strict=True))


@query(sql("scored", f"SELECT grp, structure, round({_MODEL_SCORE}, 5) AS model_score FROM ({_FEATURES})"))
def saved_ranker_scores(spark, d):
    """A ranker of given weights, saved, loaded again and applied."""
    path = files.scratch_path(spark, "ranker")
    ranker.Ranker(ranker.RankerConfig(), tuple(WEIGHTS)).save(spark, path)
    return rounded(ranker.Ranker.load(spark, path).predict(_features(spark, d)).select("grp", "structure", "model_score"), 5)


@query(sql("scored", f"SELECT grp, structure, round({tree_sql(ENSEMBLE)}, 6) AS model_score FROM ({_FEATURES})"))
def saved_ensemble_scores(spark, d):
    """An ensemble of given trees, saved, loaded again and walked over Arrow batches."""
    path = files.scratch_path(spark, "ensemble")
    ENSEMBLE.save(spark, path)
    return rounded(trees.Ensemble.load(spark, path).predict(_features(spark, d).select("grp", "structure", *scoring.MODEL_FEATURES)).select("grp", "structure", "model_score"))


@query(sql("scored", f"SELECT grp, structure, 17::BIGINT AS n_features, round({' + '.join(scoring.FEATURES)}, 5) AS total FROM ({_FEATURES})"))
def feature_vectors(spark, d):
    """The features as one array a row, in their order."""
    x = _features(spark, d).select("grp", "structure", scoring.feature_array().alias("x"))
    return rounded(x.select("grp", "structure", F.size("x").cast("long").alias("n_features"), F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v).alias("total")), 5)


# checks
@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def checked_lookup(spark, d):
    """Columns required at entry and a lookup that fails the job where a key is absent."""
    rows = require(b.table(spark, d, "customer"), ["c_custkey", "c_nationkey"]).select("c_custkey", "c_nationkey")
    return looked_up(rows, b.table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "n_name")


_FAULTY = "SELECT CASE WHEN event_id % 41 = 0 THEN NULL ELSE (event_id // 5)::VARCHAR END AS query_id, CASE WHEN event_id % 43 = 0 THEN NULL ELSE (event_id % 5 - CASE WHEN event_id % 35 = 1 THEN 1 ELSE 0 END)::VARCHAR END AS candidate_id, CASE event_id % 47 WHEN 0 THEN 2 WHEN 1 THEN NULL ELSE event_id % 2 END AS target, CASE event_id % 53 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS f FROM events"


@query(f"SELECT count(*) AS n_rows, count_if(query_id IS NULL)::BIGINT AS n_null_query, count_if(candidate_id IS NULL)::BIGINT AS n_null_candidate, count_if(target IS NULL OR target NOT IN (0, 1))::BIGINT AS n_bad_target, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT query_id, candidate_id FROM ({_FAULTY}))))::BIGINT AS n_repeated, count_if(f IS NULL OR NOT isfinite(f))::BIGINT AS n_not_finite FROM ({_FAULTY})")
def faulty_rows(spark, d):
    """Ranking rows with every fault, counted in one pass."""
    e = F.col("event_id")
    rows = b.table(spark, d, "events").select(
        F.when(e % 41 != 0, F.floor(e / 5).cast("string")).alias("query_id"),
        F.when(e % 43 != 0, (e % 5 - F.when(e % 35 == 1, 1).otherwise(0)).cast("string")).alias("candidate_id"),
        F.when(e % 47 == 0, 2).when(e % 47 != 1, e % 2).cast("int").alias("target"),
        F.when(e % 53 == 0, float("nan")).when(e % 53 == 1, float("inf")).when(e % 53 != 2, F.col("value")).alias("f"),
    )
    return violations(rows, ["f"])


@query(sql("scored", "SELECT grp AS query_id, structure AS candidate_id, (structure % 5 = 0)::INT AS target, row_number() OVER (ORDER BY grp, structure) - 1 AS place FROM (SELECT DISTINCT grp, structure FROM scored)"))
def ranking_order(spark, d):
    """Checked ranking rows in the order of query and candidate, with their place in it."""
    from .ranking_queries import _ranking_rows

    rows = checked(_ranking_rows(spark, d)).withColumn("key", F.col("query_id") * 10_000_000 + F.col("candidate_id"))
    return splits.dense_index(rows, "key", "place").select(F.col("query_id").cast("int").alias("query_id"), "candidate_id", "target", F.col("place").cast("long").alias("place"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 3")
def most_frequent(spark, d):
    """The head of a report: the three most frequent values."""
    return profiling.value_counts(b.table(spark, d, "part"), "p_brand", 3)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orders_of_others(spark, d):
    """Rows whose key is not among the wanted ones: an anti join."""
    good = b.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return b.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(good, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT count_if(a.k IS NOT NULL AND z.k IS NOT NULL)::BIGINT AS n_both, count_if(z.k IS NULL)::BIGINT AS n_left_only, count_if(a.k IS NULL)::BIGINT AS n_right_only, count(*) AS n_union, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_left_repeated, 0::BIGINT AS n_right_repeated, false AS is_bijection FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey + 7 AS k FROM customer) z USING (k)")
def shifted_alignment(spark, d):
    """Two id spaces that are not one to one: keys of either only, and keys that are repeated."""
    return pools.key_overlap_checked(b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), b.table(spark, d, "customer").select((F.col("c_custkey") + 7).alias("k")), "k")


@query("SELECT c_custkey, c_nationkey, t.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) t ON o_custkey = c_custkey")
def one_to_one_left_join(spark, d):
    """A left join whose keys are held to be unique on both sides, or the job fails."""
    urgent = b.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return pools.one_to_one(b.table(spark, d, "customer").select("c_custkey", "c_nationkey"), urgent, ["c_custkey"], "left")


# peaks
_CASES = "SELECT l_orderkey AS k, list(l_extendedprice / 100 ORDER BY l_extendedprice) AS mzs, list(l_quantity / 50 ORDER BY l_extendedprice) AS ints FROM (SELECT DISTINCT l_orderkey, l_extendedprice, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1"


@query(f"SELECT count(*) AS n_spectra, count_if(k % 17 = 0)::BIGINT AS n_length_mismatch, count_if(k % 13 = 0)::BIGINT AS n_unsorted, count_if(k % 11 = 0)::BIGINT AS n_not_finite, count_if(k % 7 = 0)::BIGINT AS n_negative, count_if(k % 5 = 0)::BIGINT AS n_above_one, count_if(k % 3 = 0)::BIGINT AS n_duplicate_mz, count_if(list_max(mzs) > 602)::BIGINT AS n_above_precursor FROM ({_CASES})")
def peak_integrity_faults(spark, d):
    """Peak arrays with every fault: lengths, order, values that aren't finite, negative or over one, repeats, beyond the precursor."""
    rows = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_extendedprice").agg(F.max("l_quantity").alias("l_quantity"))
    rows = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_extendedprice") / 100).alias("mz"), (F.col("l_quantity") / 50).alias("intensity")))).alias("p"))
    k, mzs, ints = F.col("k"), F.col("p.mz"), F.col("p.intensity")
    mzs = F.when(k % 3 == 0, F.concat(F.slice(mzs, 1, 1), mzs)).otherwise(mzs)
    ints = F.when(k % 3 == 0, F.concat(F.slice(ints, 1, 1), ints)).otherwise(ints)
    # of several faults each takes one of the first places, so that the length stays; a short list is filled up first
    filler = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.lit(0.5))
    mzs, ints = F.concat(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: i / 100.0), mzs), F.concat(filler, ints)
    faults = F.array(F.when(k % 5 == 0, 1.5).otherwise(0.5), F.when(k % 7 == 0, -0.5).otherwise(0.5), F.when(k % 11 == 0, float("nan")).otherwise(0.5))
    ints = F.concat(faults, F.slice(ints, 4, 1_000_000))
    ints = F.when(k % 17 == 0, F.concat(ints, F.array(F.lit(0.5)))).otherwise(ints)
    mzs = F.when(k % 13 == 0, F.reverse(mzs)).otherwise(mzs)
    return peaks.integrity(rows.select(mzs.alias("mzs"), ints.alias("intensities"), F.lit(600.0).alias("precursor_mz")))


@query(sql("peaks", "SELECT count(*) AS n_spectra, round(avg(n), 6) AS mean_before, round(avg(kept), 6) AS mean_after, round(100 * (1 - sum(kept) / sum(n)), 6) AS percent_removed, count_if(kept = 0)::BIGINT AS n_empty FROM (SELECT spectrum_id, count(*) AS n, count_if(intensity >= top * 0.5e0 AND mz <= 300) AS kept FROM (SELECT *, max(CASE WHEN mz <= 300 THEN intensity END) OVER (PARTITION BY spectrum_id) AS top FROM peaks) GROUP BY 1)"))
def peak_reduction_by_spectrum(spark, d):
    """What preprocessing leaves of each spectrum: means before and after, percent removed, spectra left without a peak."""
    rows = b.peaks(spark, d).withColumn("precursor_mz", F.lit(298.0))
    profile = peak_arrays.PeakProfile(min_relative_intensity=0.5, max_peaks=None, precursor_tolerance_da=2.0, remove_duplicate_mz=False)
    return rounded(peaks.reduction(rows, peaks.preprocess(rows, profile, precursor="precursor_mz")))


@query(sql("peaks", "SELECT spectrum_id, n, 128::BIGINT AS padded, least(n, 128) AS n_mask, round(total * 1e4)::BIGINT AS scaled_total_e7 FROM (SELECT spectrum_id, count(*) AS n, sum(mz) AS total FROM peaks GROUP BY 1)"))
def padded_arrays(spark, d):
    """Arrays checked for length and finite values, m/z over 1000, padded to 128 with a mask."""
    rows = b.peaks(spark, d).groupBy("spectrum_id").agg(F.collect_list("mz").alias("mzs"), F.collect_list("intensity").alias("ints"))
    rows = rows.withColumn("p", peak_arrays.zipped(F.col("mzs"), F.col("ints")))
    x, mask = vectors.scaled_padded(F.col("p.mz")), vectors.pad_mask(F.col("p"))
    n_mask = F.size(F.filter(mask, lambda m: m))
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    return rounded(rows.select("spectrum_id", F.size("p").cast("long").alias("n"), F.size(x).cast("long").alias("padded"), n_mask.cast("long").alias("n_mask"), F.round(total * 1e7).cast("long").alias("scaled_total_e7")))


# embeddings
_SPOILED = "SELECT vec_id, label, CASE vec_id % 10 WHEN 0 THEN list_transform(embedding, lambda x: 0::DOUBLE) WHEN 1 THEN list_concat(list_transform(embedding[1:63], lambda x: x::DOUBLE), ['nan'::DOUBLE]) WHEN 2 THEN list_transform(embedding[1:60], lambda x: x::DOUBLE) ELSE list_transform(embedding, lambda x: 2 * x::DOUBLE) END AS v FROM embeddings"


@query(f"SELECT count(*) AS n, count_if(len(v) <> 64)::BIGINT AS n_wrong_size, count_if(vec_id % 10 = 1)::BIGINT AS n_not_finite, count_if(vec_id % 10 = 0)::BIGINT AS n_zero, round(min(norm), 5) AS min_norm, round(avg(norm), 5) AS mean_norm, round(max(norm), 5) AS max_norm FROM (SELECT *, CASE WHEN vec_id % 10 <> 1 THEN sqrt(list_sum(list_transform(v, lambda x: x * x))) END AS norm FROM ({_SPOILED}))")
def embedding_statistics(spark, d):
    """Vectors of a wrong size, with values that aren't finite, of zeros; norms of the finite ones."""
    v = F.col("embedding").cast("array<double>")
    spoiled = F.when(F.col("vec_id") % 10 == 0, F.transform(v, lambda x: F.lit(0.0))).when(F.col("vec_id") % 10 == 1, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))).when(F.col("vec_id") % 10 == 2, F.slice(v, 1, 60)).otherwise(F.transform(v, lambda x: 2 * x))
    return rounded(profiling.vector_statistics(b.table(spark, d, "embeddings").withColumn("v", spoiled), "v", 64), 5)


@query("SELECT n, count(*) AS n_rows FROM (SELECT len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) // 100 AS n FROM documents) GROUP BY 1")
def list_lengths(spark, d):
    """How long the lists of a nested column are, in hundreds."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    return profiling.list_lengths(b.table(spark, d, "documents").withColumn("w", words), "w", 100)


_DOMAIN = ("o_orderstatus = 'F'", "o_totalprice BETWEEN 1000 AND 200000")


@query(f"SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_structures, count(DISTINCT CASE WHEN {_DOMAIN[0]} THEN o_custkey END) AS n_structures_status, count(DISTINCT CASE WHEN {_DOMAIN[0]} AND {_DOMAIN[1]} THEN o_custkey END) AS n_structures_all FROM orders GROUP BY 1")
def library_structures(spark, d):
    """Distinct structures of each library, of its rows that match, and of those that match in all."""
    status, price = (F.expr(x) for x in _DOMAIN)
    return profiling.distinct_profile(b.table(spark, d, "orders"), "o_custkey", {"status": status, "all": status & price}, ["o_orderpriority"], "structures")


@query(sql("scored", "SELECT round((SELECT avg(won) FROM (SELECT arg_max((structure % 5 = spectrum_id % 5)::INT, (score, -structure)) AS won FROM scored GROUP BY spectrum_id)), 6) AS forward, round((SELECT avg(won) FROM (SELECT arg_max((structure % 5 = spectrum_id % 5)::INT, (score, -spectrum_id)) AS won FROM scored GROUP BY structure)), 6) AS backward"))
def both_accuracies(spark, d):
    """In-batch accuracy of the best candidate a spectrum, and of the best spectrum a candidate."""
    packed = b.blocks_of_scores(spark, d)
    if packed:
        won = F.avg((F.col("best_id") % 5 == F.col("query") % 5).cast("double"))
        sides = [group_blocks.best_true(*p, group_blocks.any_candidate).agg(won.alias(name)) for name, p in (("forward", packed), ("backward", packed[::-1]))]
        return rounded(sides[0].crossJoin(sides[1]))  # one row each
    rows = b.scored(spark, d).withColumn("target", (F.col("structure") % 5 == F.col("spectrum_id") % 5).cast("int"))
    return rounded(metrics.top_accuracies(rows, "spectrum_id", "structure", "target"))


@query(sql("scored", "SELECT count(*) AS n_queries, sum(n)::BIGINT AS n_rows, sum(p)::BIGINT AS n_positive, (sum(n) - sum(p))::BIGINT AS n_negative, count_if(p = 1)::BIGINT AS n_one_positive, count_if(p = 0)::BIGINT AS n_without_positive, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM (SELECT grp, spectrum_id % 5 AS s, count(*) AS n, count_if(structure % 37 = spectrum_id % 37) AS p FROM scored GROUP BY 1, 2)"))
def ranking_summary(spark, d):
    """Nine counters of a ranking table."""
    rows = b.scored(spark, d).select(F.concat_ws("|", F.col("grp").cast("string"), (F.col("spectrum_id") % 5).cast("string")).alias("query_id"), (F.col("structure") % 37 == F.col("spectrum_id") % 37).cast("int").alias("target"))
    return rounded(profiling.ranking_summary(rows))


# training side
@query(sql("spectra vecs", "SELECT s.spectrum_id, (s.grp % 1000) // 2 AS structure, s.split, round(list_sum(list_transform(list_zip(a.embedding, m.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS agreement FROM (SELECT *, CASE WHEN ('0x' || substr(sha256('split-v1|' || (grp % 1000) // 2), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616e0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM spectra) s JOIN vecs a ON a.vec_id = 2 * (s.spectrum_id % a.n_even) JOIN vecs m ON m.vec_id = 2 * (((s.grp % 1000) // 2) % m.n_odd) + 1"))
def paired_dataset(spark, d):
    """Each spectrum beside its molecule's vector, by the alignment of both id spaces, with its structure's split."""
    rows = b.spectra(spark, d).select("spectrum_id", F.expr("(grp % 1000) div 2").alias("structure"))
    return rounded(b.with_vectors(splits.structure_split(rows, "structure"), spark, d).select("spectrum_id", "structure", "split", F.col("score").alias("agreement")))


@query(sql("scored", "SELECT key AS query_id, structure AS candidate_id FROM (SELECT *, sum(n) OVER (ORDER BY key) AS until FROM (SELECT spectrum_id AS key, count(*) AS n FROM scored GROUP BY 1)) k JOIN scored s ON s.spectrum_id = k.key WHERE until <= 3000"))
def complete_head(spark, d):
    """The first 3,000 rows by query, without the query that the bound cuts."""
    rows = b.scored(spark, d).select(F.col("spectrum_id").alias("query_id"), F.col("structure").alias("candidate_id"))
    return splits.complete_groups(rows, "query_id", 3000)


@query(PAIRS)
def hashed_pairs(spark, d):
    """Positives and negatives over all vectors, drawn by hash order: each vector with the next of its label, and with the
    next of all where that has another label."""
    return drawn_scores(spark, d)


@query(f"SELECT positive, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90, round(avg((score >= 2e-1)::INT), 6) AS pass_rate, round((SELECT sum((p.score > q.score)::INT)::DOUBLE / count(*) FROM (SELECT score FROM ({PAIRS}) WHERE positive) p, (SELECT score FROM ({PAIRS}) WHERE NOT positive) q), 6) AS auc FROM ({PAIRS}) GROUP BY 1")
def discrimination(spark, d):
    """How well similarity tells positive pairs from negative ones, over pairs drawn from all vectors: summaries, pass
    rates, and the share of (positive, negative) in which the positive scores more."""
    from ..operators.cells import aggregated

    pairs = hashed_pairs(spark, d)
    plain = [F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg((F.col("score") >= 0.2).cast("double")).alias("pass_rate")]
    return rounded(aggregated(pairs, ["positive"], plain, "score", {"p10": 0.1, "median": 0.5, "p90": 0.9}).crossJoin(F.broadcast(profiling.exact_auc(pairs, "score", "positive"))))  # one row
