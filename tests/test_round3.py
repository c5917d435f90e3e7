"""Small tests of what FINDINGS_r03.md asks for."""

import datetime

import pytest

from peakloom.plans import bindings, spectrum_queries  # noqa: F401  it registers
from tests.oracle import differences, expected, found


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_peak_reduction_merges_equal_mz(spark, tmp_path):
    rows = [(1, 100.0, 10.0), (1, 100.0, 20.0), (1, 200.0, 20.0), (1, 300.0, 10.0), (2, 100.0, 5.0)]
    _write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_extendedprice double, l_quantity double")
    f, sql = bindings.REGISTERED["peak_reduction"]
    assert f(spark, str(tmp_path)).collect()[0].asDict() == {"n_before": 5, "n_after": 3}
    assert differences(f(spark, str(tmp_path)), str(tmp_path), sql) == ""


def _mass_tables(spark, folder, n_events):
    start = datetime.datetime(2024, 1, 1)
    _write(spark, folder, "events", [(i, start, i % 7, "click" if i % 4 else "view", 1.0, "{}") for i in range(n_events)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    _write(spark, folder, "part", [(i, "n", f"b{i % 3}", 900.0 + i * 0.02) for i in range(300)], "p_partkey long, p_name string, p_brand string, p_retailprice double")


POOLED = ["pool_union", "pool_intersection", "pool_select_library", "availability_mask", "hybrid_sweep", "flat_pool_manifest", "pool_profile", "pool_growth", "multi_observation_filter", "survival_sweep", "mass_error_feature"]


def test_groups_of_equal_masses_are_asked_once(spark, tmp_path_factory):
    one, four = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("four")
    _mass_tables(spark, one, 21_000)  # one period of the masses
    _mass_tables(spark, four, 84_000)
    n = [bindings.shared_hits(spark, str(f))[2].count() for f in (one, four)]
    assert n[0] == n[1] > 0


@pytest.mark.parametrize("name", POOLED)
def test_pools_of_repeated_groups(spark, tmp_path, name):
    from peakloom.plans import mass_queries, ranking_queries  # noqa: F401  they register

    _mass_tables(spark, tmp_path, 43_000)
    f, sql = bindings.REGISTERED[name]
    assert differences(f(spark, str(tmp_path)), str(tmp_path), sql) == ""


def _vectors(spark):
    import random

    draw = random.Random(5)
    rows = [(i, i % 2, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, 0, rows[2 * i][2]) for i in range(20)]  # copies: equal scores
    rows += [(300, 0, None), (301, 1, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "id long, grp int, x array<float>").repartition(3).cache()


def test_statistics_of_many_blocks(spark):
    import numpy as np

    from peakloom.operators import group_blocks

    v = _vectors(spark)
    q, r = group_blocks.packed(v.where("id % 3 = 0"), "grp", "id", "x", 7), group_blocks.packed(v.where("id % 3 <> 0"), "grp", "id", "x", 5)
    held = {(x.grp, x.id): np.array(x.x, float) for x in v.collect() if x.x and x.x[0] == x.x[0]}
    for wanted in ("all", "logsumexp"):
        rows = group_blocks.statistics(q, r, wanted).collect()
        assert len(rows) == sum(i % 3 != 0 for _, i in held)
        for row in rows:
            s = sorted(float(m @ held[row.grp, row.structure]) for (g, i), m in held.items() if g == row.grp and i % 3 == 0)
            assert row.n == len(s) and abs(row.mean - np.mean(s)) < 1e-9 and abs(row.top - s[-1]) < 1e-9
            if wanted == "all":
                assert abs(row.std - np.std(s)) < 1e-9 and abs(row.low - s[0]) < 1e-9 and abs(row.top2 - (s[-1] + s[-2]) / 2) < 1e-9
            else:
                assert abs(row.logsumexp - (s[-1] + 0.1 * np.log(sum(np.exp((x - s[-1]) / 0.1) for x in s)))) < 1e-9


def test_places_of_equal_scores(spark):
    from peakloom.operators import group_blocks

    v = _vectors(spark)
    q, c = v.where("id % 3 = 0"), group_blocks.packed(v.where("id % 3 <> 0"), "grp", "id", "x", 5)
    best = group_blocks.best_true(group_blocks.packed(q, "grp", "id", "x", 7), c, lambda a, b: b % 7 == a % 7)
    own = group_blocks.packed(q.join(best.withColumnRenamed("query", "id"), "id", "left"), "grp", "id", "x", 7, ("best", "best_id"))
    got = {x["query"]: x["rank"] for x in group_blocks.places(own, c).collect()}
    held = {(x.grp, x.id): x.x for x in v.collect() if x.x and x.x[0] == x.x[0]}
    want = {}
    for (g, i), a in held.items():
        if i % 3 == 0:
            order = sorted((-sum(p * z for p, z in zip(a, b, strict=True)), j) for (h, j), b in held.items() if h == g and j % 3)
            want[i] = next((n for n, (_, j) in enumerate(order, 1) if j % 7 == i % 7), None)
    assert got == want


def test_scores_send_no_pairs_through_a_shuffle(spark, sf):
    plan = bindings.score_blocks(spark, sf, "max")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


CELLED = ["reranker_training_rows", "inference_features", "manifest_submission", "reranked_manifest"]


@pytest.mark.parametrize("name", CELLED)
def test_pools_of_cells(spark, sf, tmp_path, name):
    """Copied vectors (equal scores), masses that share windows; the pairs are no row of a shuffle."""
    from peakloom.plans import inference_queries  # noqa: F401  it registers

    _mass_tables(spark, tmp_path, 3_000)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 20").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert differences(made, str(tmp_path), sql) == ""


def test_rounding_of_halves():
    import numpy as np

    from peakloom.operators.mass_cells import places, rounded

    assert rounded(np.array([0.0562385, -0.0562385, -1e-9, 0.1234564]), 6, 9).tolist() == [0.056239, -0.056239, 0.0, 0.123456]
    assert places(np.array([0.5, 0.7, 0.5])).tolist() == [2.0, 1.0, 3.0]


SPARSE = ["index_search", "chemistry_comparison", "multispectrum_metrics"]


@pytest.mark.parametrize("name", SPARSE)
def test_sparse_scores_of_many_parts(spark, tmp_path, name, monkeypatch):
    """Spectra that share bins and copies (equal scores), in several parts; pairs are no row of a shuffle."""
    from peakloom.operators import sparse_blocks
    from peakloom.plans import evaluation_queries  # noqa: F401  it registers

    rows = [(i, 1000.0 + 10 * ((i * (k + 3) + k) % 40), 1.0 + (i * k) % 7) for i in range(400) for k in range(4)]
    rows += [(1000 + i, 1000.0 + 10 * (i % 5), 2.0) for i in range(60)]  # copies
    rows += [(5000, 90_000.0, 1.0)]  # a query that shares no bin
    _write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_extendedprice double, l_quantity double")
    monkeypatch.setattr(sparse_blocks, "POSTINGS", 90)
    monkeypatch.setattr(sparse_blocks, "TRIPLES", 50)
    f, sql = bindings.REGISTERED[name]
    made = f(spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert differences(made, str(tmp_path), sql) == ""


def test_more_parts_than_structures(spark, tmp_path):
    from peakloom.operators import sparse_blocks

    rows = spark.createDataFrame([(i, [i % 3, 5], [0.6, 0.8]) for i in range(40)], "id long, bins array<int>, vals array<double>")
    q = rows.where("id < 5").selectExpr("id AS grp", "id", "bins", "vals")
    r = rows.selectExpr("id", "bins", "vals", "id % 2 AS label", "cast(id % 10 AS int) AS part")
    found = sparse_blocks.reduced(q, r, sparse_blocks.best_by_label, sparse_blocks.LABELLED, 10)
    got = {x["query"]: sorted((e.structure, round(e.score, 6)) for e in x.entries) for x in sparse_blocks.merged(found, "query", ["score"], whole=False).collect()}
    assert got == {i: [(0, 1.0), (1, 1.0)] for i in range(5)}


def test_equal_texts_are_read_once(spark, tmp_path, monkeypatch):
    from peakloom.functions import smiles
    from peakloom.plans import structure_queries

    spark.range(2_600).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    read = spark.sparkContext.accumulator(0)
    graph = smiles.smiles_graph

    def counted(column):
        from pyspark.sql.functions import udf

        return graph(udf(lambda t: read.add(1) or t, "string")(column))

    monkeypatch.setattr(smiles, "smiles_graph", counted)
    rows = structure_queries.structure_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in rows) == list(range(2_600)) and 0 < read.value < 1_000
    assert all((r.fate == "empty") == (r.id % 13 == 0) and (r.bits is None) == (r.fate != "read") for r in rows)


def test_array_chain_asks_for_its_input_once(spark):
    from pyspark.sql import functions as F

    from peakloom.functions.peak_arrays import PeakProfile, preprocessed

    rows = spark.createDataFrame([(1, [(100.0, 10.0), (100.0, 20.0), (200.0, 0.1), (300.0, 15.0)])], "id int, given array<struct<mz:double,intensity:double>>")
    made = rows.select(preprocessed(F.col("given"), None, PeakProfile(min_relative_intensity=0.02, max_peaks=4)).alias("p"))
    assert made._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0].count("given#") == 1
    assert [(p.mz, round(p.intensity, 6)) for p in made.first().p] == [(100.0, 1.0), (300.0, 0.707107)]


def _ranking_rows(spark, sizes, seed=4):
    import random

    draw = random.Random(seed)
    rows = []
    for q, (p, n) in enumerate(sizes):
        for c in range(p + n):
            hit = c < p
            rows.append((q, c, int(hit), draw.gauss(0.7 if hit else 0.0, 1), 40 * draw.gauss(0.2 * hit, 1), 3.0 + q))  # the last one is equal in a query
    return spark.createDataFrame(rows, "query_id long, candidate_id long, target int, f0 double, f1 double, f2 double").repartition(3)


@pytest.mark.parametrize("objective", ["rank:pairwise", "rank:ndcg", "rank:map"])
def test_ranker_over_blocks_is_sparks_regression_over_pairs(spark, monkeypatch, objective):
    from pyspark.ml.classification import LogisticRegression

    from peakloom.operators import ranker

    monkeypatch.setattr(ranker, "POSITIVES", 7)
    monkeypatch.setattr(ranker, "NEGATIVES", 11)
    rows = _ranking_rows(spark, [(3, 20), (10, 40), (0, 5), (4, 0), (1, 30)])
    names = ["f0", "f1", "f2"]
    pairs = ranker.difference_pairs(rows, names, objective=objective).cache()
    for n in (1, 3, 6):
        model = LogisticRegression(maxIter=n, regParam=1e-2, fitIntercept=False, standardization=True, weightCol="weight").fit(pairs)
        got = ranker.fit(rows, ranker.RankerConfig(objective, max_iter=n, reg=1e-2, features=tuple(names)))
        assert got.weights == pytest.approx(tuple(model.coefficients), rel=1e-6) and got.weights[2] == 0


def test_ranker_makes_no_row_of_a_pair(spark):
    from peakloom.operators import ranker

    rows = _ranking_rows(spark, [(700, 4000)])
    blocks = ranker.pair_blocks(rows, ["f0", "f1", "f2"])
    assert blocks.count() == 2 * 2
    assert ranker._added(blocks, 5, lambda p, n: p[:1, 0] * 0 + len(p) * len(n)).tolist() == [700 * 4000]


@pytest.mark.parametrize("objective", ["rank:pairwise", "rank:ndcg", "rank:map"])
def test_gradients_of_a_query_of_very_many_pairs(spark, objective):
    """24 million pairs, which were a row each; scores with and without ties, and a query without positives."""
    import numpy as np

    from peakloom.operators import trees

    rng = np.random.default_rng(6)
    n, hit = 14_000, rng.random(14_000) < 0.2
    score = rng.choice([-0.5, 0.0, 0.125, 0.4], n)
    rows = [(1, i, int(h), [0], float(s)) for i, (h, s) in enumerate(zip(hit, score, strict=True))] + [(2, i, 0, [0], 0.0) for i in range(9)]
    state = spark.createDataFrame(rows, "query long, id long, target int, bins array<int>, score double").repartition(3)
    config = trees.TreeConfig(objective)
    classes = [x for x in trees.gradients(state, config).collect()]
    assert len(classes) == len(rows) and all(x.g == x.h == 0 for x in classes if x.query == 2)
    got = np.array([(x.g, x.h) for x in sorted((x for x in classes if x.query == 1), key=lambda x: x.id)], float) / trees.UNIT
    place = np.empty(n)
    place[np.lexsort((np.arange(n), -score))] = np.arange(1, n + 1)
    worth = {"rank:pairwise": place, "rank:ndcg": 1 / np.log2(place + 1), "rank:map": 1 / place}[objective]
    p, m = np.flatnonzero(hit), np.flatnonzero(~hit)
    w = np.ones((len(p), len(m))) if objective == "rank:pairwise" else np.abs(worth[p][:, None] - worth[m])
    wrong = 1 / (1 + np.exp(score[p][:, None] - score[m]))
    want = np.zeros((n, 2))
    for k, x in enumerate((w * wrong, w * wrong * (1 - wrong))):
        want[m, k], want[p, k] = x.sum(0) / w.sum(), x.sum(1) / w.sum() * (-1 if k == 0 else 1)
    assert np.abs(got - want).max() < 3e-9


def test_error_function_to_double_precision():
    import math

    import numpy as np

    from peakloom.operators import layers

    x = np.concatenate([np.linspace(-7, 7, 20_001), [-0.0, 1e-300, np.inf, -np.inf]])
    assert np.abs(layers.erf(x) - [math.erf(v) for v in x]).max() < 5e-16 and np.isnan(layers.erf(np.array([np.nan]))).all()


def test_a_batch_is_a_row_and_a_step_asks_for_ranges(spark):
    from peakloom.operators import training

    rows = spark.createDataFrame([(i // 3, 20 - i, i, [float(i)], [1.0], 1.0, [1]) for i in range(20)], "batch long, item long, structure long, mzs array<double>, intensities array<double>, precursor_mz double, fingerprint array<int>")
    held = {r.batch: [x["item"] for x in r.rows] for r in training.laid_out(rows, 3).collect()}
    assert held == {b: sorted(20 - i for i in range(20) if i // 3 == b) for b in range(7)}
    for n, per_step in ((7, 3), (7, 7), (5, 9), (1, 1)):
        for step in range(8):
            want = {(step * per_step + i) % n for i in range(min(per_step, n))}
            got = [b for low, high in training.asked(step, per_step, n) for b in range(low, high)]
            assert set(got) == want and len(got) == len(want)
