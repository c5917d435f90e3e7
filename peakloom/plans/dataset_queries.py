"""Queries over tables: scans, splits, catalogs, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import catalog, pools, profiling, splits
from . import bindings as b
from .bindings import query, rounded, sql

FRACTION = "('0x' || substr(sha256('split-v1|' || {}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616e0"


@query("SELECT l_orderkey, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def projected_scan(spark, d):
    rows = b.table(spark, d, "lineitem").where("l_shipdate >= timestamp '1995-01-01'")
    return rounded(rows.select("l_orderkey", "l_extendedprice"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def wanted_rows(spark, d):
    """Rows of wanted keys only, by a semi join."""
    wanted = b.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return b.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unwanted_rows(spark, d):
    return b.table(spark, d, "customer").select("c_custkey").join(b.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def first_rows(spark, d):
    """The first rows by key: a preview."""
    return b.table(spark, d, "events").select("event_id", "user_id").orderBy("event_id").limit(100)


@query("SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS n_orders, round(sum(o.o_totalprice), 3) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2")
def lookup_join(spark, d):
    nations = F.broadcast(b.table(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows
    totals = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    c = b.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return c.join(totals, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"), F.round("total", 3).alias("total"))


@query("SELECT n_left_missing, n_right_missing FROM (SELECT count_if(o_custkey IS NULL)::BIGINT AS n_left_missing, count_if(c_custkey IS NULL)::BIGINT AS n_right_missing FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey)")
def key_alignment(spark, d):
    """Two id spaces side by side: keys that only one of them has."""
    overlap = pools.key_overlap(b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    return overlap.select(F.col("n_right_only").alias("n_left_missing"), F.col("n_left_only").alias("n_right_missing"))


@query(sql("keyed", f"SELECT structure, CASE WHEN {FRACTION.format('structure')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM keyed"))
def structure_split(spark, d):
    rows = b.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("structure"))
    return splits.structure_split(rows, "structure")


@query(sql("keyed", f"SELECT count(*) AS n_shared FROM (SELECT structure FROM keyed WHERE {FRACTION.format('structure')} < 0.1 INTERSECT SELECT structure FROM keyed WHERE {FRACTION.format('structure')} >= 0.1)"))
def split_disjointness(spark, d):
    rows = structure_split(spark, d)
    shared = rows.where("split = 'validation'").select("structure").intersect(rows.where("split = 'train'").select("structure"))
    return shared.agg(F.count("*").alias("n_shared"))


_ORDER = "is_test_like DESC, sha256('split-v1|' || structure || '|' || row_index), row_index"


@query(sql("rows", f"SELECT row_index, CASE WHEN size < 2 THEN 'unused' WHEN n = 1 THEN 'query' ELSE 'reference' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY structure) AS size FROM rows)"))
def library_split(spark, d):
    return splits.library_split(b.keyed_rows(spark, d), "structure", "row_index", F.col("is_test_like")).select("row_index", "role")


@query(sql("rows", f"SELECT row_index, CASE WHEN n <= least(3, good, size - 1) THEN 'query' ELSE 'reference' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY structure) AS size, count_if(is_test_like) OVER (PARTITION BY structure) AS good FROM rows) WHERE size >= 3 AND good >= 2"))
def multispectrum_split(spark, d):
    return splits.multispectrum_split(b.keyed_rows(spark, d), "structure", "row_index", F.col("is_test_like")).select("row_index", "role")


@query(sql("rows", f"SELECT row_index, structure, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY {_ORDER}) AS n FROM rows) WHERE n <= 6"))
def manifest_cap(spark, d):
    order = [F.desc("is_test_like"), keys.stable_order(F.col("structure"), F.col("row_index")), F.col("row_index")]
    return splits.capped(b.keyed_rows(spark, d), ["structure"], order, 6).select("row_index", "structure", F.col("place").cast("long").alias("place"))


@query(sql("rows", f"SELECT split, count(DISTINCT structure) AS n FROM (SELECT structure, CASE WHEN row_number() OVER (ORDER BY f, structure) <= round_even(0.2 * count(*) OVER (), 0) THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT structure, {FRACTION.format('structure')} AS f FROM rows)) GROUP BY 1"))
def molecule_disjoint_split(spark, d):
    rows = b.keyed_rows(spark, d).select("row_index", "structure")
    return splits.grouped_split(rows, "structure").groupBy("split").agg(F.count_distinct("structure").alias("n"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer")
def dense_index(spark, d):
    out = splits.dense_index(b.table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return out.select("c_custkey", F.col("row_index").cast("long").alias("row_index"))


@query(sql("rows", "SELECT structure, arg_min(o_orderpriority, row_index) AS o_orderpriority, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_priorities, count_if(is_test_like)::BIGINT AS n_test_like FROM (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY row_index) = 1) GROUP BY 1"))
def structure_rollup(spark, d):
    return catalog.rollup(b.keyed_rows(spark, d), "structure", "row_index", ["o_orderpriority"], {"n_priorities": "o_orderpriority"}, {"n_test_like": F.col("is_test_like")})


@query(sql("variants", "SELECT structure, arg_min(smiles, exact_mass) AS smiles, count(*) AS n_rows, count(DISTINCT formula) AS n_formulas, count_if(exact_mass > 950)::BIGINT AS n_heavy FROM variants GROUP BY 1"))
def candidate_catalog(spark, d):
    return catalog.rollup(b.variants(spark, d), "structure", "exact_mass", ["smiles"], {"n_formulas": "formula"}, {"n_heavy": F.col("exact_mass") > 950})


@query(sql("variants", "SELECT structure, count(DISTINCT smiles) AS n_names, count(DISTINCT formula) AS n_formulas, count(DISTINCT exact_mass) AS n_masses, round(min(exact_mass), 6) AS min_mass, round(max(exact_mass), 6) AS max_mass, round(max(exact_mass) - min(exact_mass), 6) AS mass_range, count(DISTINCT formula) > 1 AS formula_conflict, max(exact_mass) - min(exact_mass) > 1e-6 AS mass_conflict FROM variants GROUP BY 1"))
def ambiguity_audit(spark, d):
    return rounded(catalog.ambiguity(b.variants(spark, d), "structure", "smiles", "formula", "exact_mass"))


_BOTH = "SELECT *, 'a' AS source FROM source_a UNION ALL SELECT *, 'b' FROM source_b"


@query(sql("source_a source_b", f"SELECT v.structure, v.smiles, round(v.exact_mass, 6) AS exact_mass, s.sources, o.sources AS structure_sources FROM (SELECT *, round(exact_mass, 8) AS k FROM ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY structure, round(exact_mass, 8) ORDER BY source, smiles) = 1) v JOIN (SELECT structure, round(exact_mass, 8) AS k, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM ({_BOTH}) GROUP BY 1, 2) s USING (structure, k) JOIN (SELECT structure, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM ({_BOTH}) GROUP BY 1) o USING (structure)"))
def combined_index(spark, d):
    v = b.variants(spark, d)
    out = catalog.combined_index({"a": v.where("structure % 3 <> 0"), "b": v.where("structure % 3 <> 1")})
    return rounded(out.select("structure", "smiles", "exact_mass", "sources", "structure_sources"))


@query(sql("variants", "SELECT count_if(structure % 3 = 2)::BIGINT AS n_both, count_if(structure % 3 = 1)::BIGINT AS n_left_only, count_if(structure % 3 = 0)::BIGINT AS n_right_only, count(*) AS n_union FROM (SELECT DISTINCT structure FROM variants)"))
def overlap_counts(spark, d):
    v = b.variants(spark, d)
    return pools.key_overlap(v.where("structure % 3 <> 0"), v.where("structure % 3 <> 1"), "structure")


@query("SELECT count(*) AS n FROM ((SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))")
def symmetric_difference(spark, d):
    c, o = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), b.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.subtract(o).unionByName(o.subtract(c)).agg(F.count("*").alias("n"))


_DOMAIN = "o_orderstatus = 'F'", "o_totalprice BETWEEN 1000 AND 200000", "o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"


@query(f"SELECT o_orderkey FROM orders WHERE {' AND '.join(_DOMAIN)}")
def domain_rows(spark, d):
    """The closed-interval, equality and membership predicate of a domain match."""
    return b.table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")).select("o_orderkey")


def _flags():
    status, price, priority = (F.expr(x) for x in _DOMAIN)
    return {"status": status, "price": price, "priority": priority, "all": status & price & priority}


_FLAG_SQL = ", ".join(f"count_if({x})::BIGINT AS n_{n}, round(100 * avg(({x})::INT), 6) AS pct_{n}" for n, x in zip(("status", "price", "priority", "all"), (*_DOMAIN, " AND ".join(_DOMAIN)), strict=True))


@query(f"SELECT count(*) AS n, {_FLAG_SQL} FROM orders")
def domain_match(spark, d):
    return rounded(profiling.flag_profile(b.table(spark, d, "orders"), _flags()))


@query(f"SELECT o_orderpriority, count(*) AS n, {_FLAG_SQL} FROM orders GROUP BY 1")
def library_profile(spark, d):
    return rounded(profiling.flag_profile(b.table(spark, d, "orders"), _flags(), ["o_orderpriority"]))


@query("SELECT * FROM (SELECT 'doc_id' AS \"column\", count_if(d.doc_id IS NULL)::BIGINT AS n_missing, round(100 * avg((d.doc_id IS NULL)::INT), 6) AS percent FROM documents d UNION ALL SELECT 'quality', count_if(quality IS NULL)::BIGINT, round(100 * avg((quality IS NULL)::INT), 6) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count_if(lang IS NULL)::BIGINT, round(100 * avg((lang IS NULL)::INT), 6) FROM documents)")
def missing_profile(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", "lang").join(b.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rounded(profiling.missing_profile(rows))


@query("SELECT threshold, count_if(l_extendedprice > threshold)::BIGINT AS n_above, round(avg((l_extendedprice > threshold)::INT), 6) AS share FROM lineitem, (VALUES (1e3), (2e4), (5e4), (9e4)) t(threshold) GROUP BY 1")
def outlier_counts(spark, d):
    return rounded(profiling.threshold_counts(b.table(spark, d, "lineitem"), "l_extendedprice", [1e3, 2e4, 5e4, 9e4]))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return profiling.value_counts(b.table(spark, d, "events"), "event_type")


@query("SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events")
def described(spark, d):
    return rounded(profiling.described(b.table(spark, d, "events"), "value"))


@query("SELECT least(size, 16) AS size, count(*) AS n_groups FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1")
def group_sizes(spark, d):
    return profiling.size_distribution(b.table(spark, d, "orders"), "o_custkey").select(F.col("size").cast("long").alias("size"), "n_groups")


@query("SELECT t.threshold, count_if(n >= t.threshold)::BIGINT AS n_at_least, count_if(n = t.threshold)::BIGINT AS n_exactly FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey), (SELECT unnest(range(1, 11))::INT AS threshold) t GROUP BY 1")
def frequency_thresholds(spark, d):
    return profiling.frequency_thresholds(b.table(spark, d, "orders"), "o_custkey", list(range(1, 11)))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / count(DISTINCT o_custkey), 6) AS per_structure FROM orders GROUP BY 1")
def rows_per_structure(spark, d):
    rows = b.table(spark, d, "orders").groupBy("o_orderpriority")
    return rounded(rows.agg(F.count("*").alias("n"), (F.count("*") / F.count_distinct("o_custkey")).alias("per_structure")))


@query("SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1")
def flattened_statistics(spark, d):
    from ..functions.vectors import flattened_finite

    x = b.table(spark, d, "embeddings").select("label", F.explode(flattened_finite(F.col("embedding").cast("array<double>"))).alias("x"))
    return rounded(x.groupBy("label").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities, bool_or(o_orderpriority = '1-URGENT') AS has_urgent FROM orders GROUP BY 1")
def joined_labels(spark, d):
    out = b.table(spark, d, "orders").groupBy("o_custkey").agg(keys.joined_distinct(F.col("o_orderpriority"), "|").alias("priorities"))
    return out.withColumn("has_urgent", F.array_contains(F.split("priorities", r"\|"), "1-URGENT"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, round(min(o_totalprice), 6) AS min_price, round(max(o_totalprice), 6) AS max_price FROM orders")
def table_summary(spark, d):
    rows = b.table(spark, d, "orders")
    return rounded(rows.agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"), F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price")))


@query("SELECT a.l_orderkey AS k, count(*) AS n_pairs FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount) AS n FROM lineitem) a JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount) AS n FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.n + 1 = b.n GROUP BY 1")
def neighbour_pairs(spark, d):
    """Positive pairs inside a key: each row with the next by a total order, so a key of n rows gives n - 1 pairs."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    rows = b.table(spark, d, "lineitem").withColumn("next", F.lead("l_linenumber").over(order))
    return rows.where("next is not null").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_pairs"))
