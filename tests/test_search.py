"""The stored sparse index and the blocked dense search against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import blocks, sparse_index


def some_bins(n=120, common=3, seed=4):
    """Spectra of a few rare bins and some that nearly all share; some equal spectra, one of norm 0."""
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        if s % 10 == 9:
            rows += [(s, b, v) for t, b, v in rows if t == s - 1]
            continue
        rows += [(s, b, round(rng.random() * (0.3 if s % 3 else 1), 3)) for b in range(common) if rng.random() < 0.9]
        rows += [(s, 100 + b, round(rng.random() + 0.2, 3)) for b in rng.sample(range(60), 5)]
    return rows + [(n, 1, 0.0)]


def every_pair(rows, k, queries, own=False):
    spectra = {}
    for s, b, v in rows:
        spectra.setdefault(s, {})[b] = v
    spectra = {s: {b: v / n for b, v in x.items()} for s, x in spectra.items() if (n := math.sqrt(sum(v * v for v in x.values()))) > 0}
    out = []
    for q in sorted(spectra):
        if q in queries:
            scores = [(round(sum(v * y[b] for b, v in spectra[q].items() if b in y), 9), r) for r, y in spectra.items() if (own or r != q) and any(b in y for b in spectra[q])]
            out += [(q, r, s, i) for i, (s, r) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def indexed(spark):
    rows = some_bins()
    bins = spark.createDataFrame(rows, "spectrum_id long, bin long, v double")
    return rows, bins, sparse_index.build_index(bins, buckets=4, part_rows=20)


@pytest.mark.parametrize("k, own, probed", [(1, False, 30), (5, False, 1), (25, False, 2000), (5, True, 60), (500, False, 10)])
def test_search_equals_every_pair(spark, indexed, k, own, probed):
    rows, bins, index = indexed
    queries = {s for s in range(121) if s % 4 == 0 or s == 9}
    got = sparse_index.search(spark, index, bins.where(F.col("spectrum_id").isin(list(queries))), k, own=own, probed=probed).collect()
    assert sorted((r.query, r.reference, round(r.score, 9), r.rank) for r in got) == sorted(every_pair(rows, k, queries, own))


def test_common_bins_are_not_read(spark):
    """As bins get common, candidates and postings read fall behind the pairs that share a bin."""
    rng = random.Random(1)
    rows = [(s, b, 0.05) for s in range(300) for b in range(4)] + [(s, 1000 + s // 6, 1.0) for s in range(300)] + [(s, 5000 + rng.randrange(40), 0.2) for s in range(300)]
    bins = spark.createDataFrame(rows, "spectrum_id long, bin long, v double")
    index = sparse_index.build_index(bins, buckets=2)
    queries = bins.where("spectrum_id % 10 = 0")
    ranked, chosen = sparse_index.candidates(spark, index, queries, 3)
    assert chosen.count() < 30 * 299 / 10
    read = ranked.where("needed").agg(F.sum("n")).first()[0]
    assert read < ranked.agg(F.sum("n")).first()[0] / 10
    got = sparse_index.search(spark, index, queries, 3).collect()
    assert sorted((r.query, r.reference, round(r.score, 9), r.rank) for r in got) == sorted(every_pair(rows, 3, set(range(0, 300, 10))))


def test_the_index_is_joined_where_it_lies(spark, indexed):
    """No exchange stands above the scan of the postings, and a common bin has several parts."""
    _, bins, index = indexed
    postings, forward, sizes = index.tables(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, 1, 0.5, 2)], "query long, bin long, qv double, parts int")
        plan = sparse_index._joined(rows, postings, False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning(bin") == 1  # the queries' side alone
    assert sizes.where("parts > 1").count() > 0 and postings.agg(F.max("part")).first()[0] > 0


def test_checked_index(spark, indexed):
    rows, bins, index = indexed
    row = sparse_index.checked(spark, index).first()
    assert row.sound and row.n_references == 120 and row.n_postings == len(rows) - 1 and row.n_bad_length == 0
    empty = sparse_index.build_index(bins.limit(0), buckets=2)
    assert sparse_index.search(spark, empty, bins, 3).count() == 0
    assert sparse_index.search(spark, index, bins.limit(0), 3).count() == 0
    empty.drop(spark)
    with pytest.raises(ValueError):
        sparse_index.search(spark, index, bins, 0)


# --- blocks


def vectors(n=137, width=7, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    x[10] = x[11] = x[12]
    return x


@pytest.mark.parametrize("size, groups", [(16, 4), (1000, 1), (1, 3)])
def test_blocks_equal_every_pair(spark, size, groups):
    x = vectors()
    table = spark.createDataFrame([(i, v.tolist(), float(i % 3) if i % 5 else None) for i, v in enumerate(x)], "id long, x array<double>, best double").repartition(3)
    q, r = blocks.packed(table.where("id % 4 = 0"), "id", "x", "best", size), blocks.packed(table, "id", "x", size=size)
    full = np.round(x @ x.T, 6)
    some = range(0, len(x), 4)
    got = blocks.block_pairs(q, r, blocks_reduce, "query long, reference long, score double", groups).collect()
    assert sorted((g.query, g.reference, g.score) for g in got) == [(i, j, full[i, j]) for i in some for j in range(len(x))]
    want = sorted((i, j, full[i, j], n) for i in some for n, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-full[i, j], j))[:5], 1))
    assert sorted((g.query, g.reference, g.score, g.rank) for g in blocks.top_k(q, r, 5).collect()) == want
    counted = {g.query: g.larger for g in blocks.larger_counts(q, r).collect()}
    assert counted == {i: sum(full[i, j] > i % 3 for j in range(len(x)) if j != i) if i % 5 else 0 for i in some}
    assert blocks.all_scores(q, r).count() == len(some) * (len(x) - 1)


def blocks_reduce(products, q_ids, r_ids, limits):
    return blocks._each(np.round(products, 6), q_ids, r_ids, np.ones(products.shape, bool))


def test_vectors_that_do_not_fit(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1.0], None], [[1.0], [float("nan")]], [[1.0, 2.0], [None, 1.0]]):
        table = spark.createDataFrame(list(enumerate(bad)), "id long, x array<double>").coalesce(1)
        with pytest.raises(Exception, match="one length"):
            blocks.packed(table, "id", "x").collect()
    table = spark.createDataFrame([(1, [1.0])], "id long, x array<double>")
    assert blocks.top_k(blocks.packed(table.limit(0), "id", "x"), blocks.packed(table, "id", "x"), 3).count() == 0
